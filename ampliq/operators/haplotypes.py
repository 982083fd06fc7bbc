"""Haplotypes: abundance, strands, consensus, naming, insertions and deletions, downstream summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampliq.functions.dna import differences
from ampliq.sources.shared import small

SAMPLE = ("pool", "patient")


def abundant(haplotypes: DataFrame, pct: float = 0.2, min_len: int = 150) -> DataFrame:
    """Haplotypes of at least ``pct`` percent of their strand's reads and ``min_len`` long; all_reads is the length-filtered total.

    A strand's totals are an aggregate, one row a strand, which is broadcast
    after it was counted: no strand's haplotypes pass one task.
    """
    keys = [*SAMPLE, "strand"]
    totals = haplotypes.groupBy(*keys).agg(F.sum("nr").alias("_all"), F.sum(F.when(F.length("seq") >= min_len, F.col("nr")).otherwise(0)).alias("all_reads"))
    kept = haplotypes.join(small(totals), keys).where((F.col("nr") * 100 >= F.col("_all") * pct) & (F.length("seq") >= min_len))
    return kept.withColumn("freq", F.round(F.col("nr") * 100 / F.col("all_reads"), 2)).select(*haplotypes.columns, "all_reads", "freq")


def strand_join(kept: DataFrame) -> DataFrame:
    """(pool, patient, seq, fw, rv): reads of each sequence on both strands, 0 where it is missing."""
    return kept.groupBy(*SAMPLE, "seq").agg(F.sum(F.when(F.col("strand") == "fw", F.col("nr")).otherwise(0)).alias("fw"), F.sum(F.when(F.col("strand") == "rv", F.col("nr")).otherwise(0)).alias("rv"))


def strand_full_outer(kept: DataFrame) -> DataFrame:
    """The same by a full outer join of the strands."""
    fw = kept.where("strand = 'fw'").select(*SAMPLE, "seq", F.col("nr").alias("fw"))
    rv = kept.where("strand = 'rv'").select(*SAMPLE, "seq", F.col("nr").alias("rv"))
    return fw.join(rv, [*SAMPLE, "seq"], "full_outer").select(*SAMPLE, "seq", F.coalesce("fw", F.lit(0)).alias("fw"), F.coalesce("rv", F.lit(0)).alias("rv"))


def consensus(joined: DataFrame) -> DataFrame:
    """Sequences on both strands, reads summed, in order of descending reads."""
    order = Window.partitionBy(*SAMPLE).orderBy(F.desc("reads"), "seq")
    return joined.where("fw > 0 and rv > 0").withColumn("reads", F.col("fw") + F.col("rv")).withColumn("ord", F.row_number().over(order)).select(*SAMPLE, "seq", "reads", "ord")


def overlap(joined: DataFrame) -> DataFrame:
    """ovrlp: the sum of the smaller shares of both strands, in percent; common: reads on both strands of all reads, in percent."""
    totals = joined.groupBy(*SAMPLE).agg(F.sum("fw").alias("_sf"), F.sum("rv").alias("_sr"))
    shared = joined.join(small(totals), list(SAMPLE))
    both = F.when((F.col("fw") > 0) & (F.col("rv") > 0), F.col("fw") + F.col("rv")).otherwise(0)
    #: Decimals add up alike in any order.
    share = F.least(F.col("fw") / F.greatest("_sf", F.lit(1)), F.col("rv") / F.greatest("_sr", F.lit(1))).cast("decimal(30, 15)")
    out = shared.groupBy(*SAMPLE).agg(F.sum(share).cast("double").alias("o"), F.sum(both).alias("fn_rd"), F.sum(F.col("fw") + F.col("rv")).alias("_t"))
    return out.select(*SAMPLE, F.round(F.col("o") * 100, 4).alias("ovrlp"), F.round(F.col("fn_rd") * 100 / F.col("_t"), 4).alias("common"), "fn_rd")


def strand_metrics(haplotypes: DataFrame, pct: float = 0.2, min_len: int = 150) -> DataFrame:
    """Per sample and strand: all, lowf, in, unq, com."""
    total = haplotypes.where(F.length("seq") >= min_len).groupBy(*SAMPLE, "strand").agg(F.sum("nr").alias("all"))
    joined = strand_join(abundant(haplotypes, pct, min_len))
    rows = joined.select(*SAMPLE, F.explode(F.array(*(F.struct(F.lit(s).alias("strand"), F.col(s).alias("nr"), ((F.col("fw") > 0) & (F.col("rv") > 0)).alias("both")) for s in ("fw", "rv")))).alias("x")).select(*SAMPLE, "x.*")
    kept = rows.groupBy(*SAMPLE, "strand").agg(F.sum("nr").alias("in"), F.sum(F.when(F.col("both"), F.col("nr")).otherwise(0)).alias("com"))
    out = total.join(kept, [*SAMPLE, "strand"], "left").withColumns({"in": F.coalesce("in", F.lit(0)), "com": F.coalesce("com", F.lit(0))})
    return out.select(*SAMPLE, "strand", "all", (F.col("all") - F.col("in")).alias("lowf"), "in", (F.col("in") - F.col("com")).alias("unq"), "com")


def metric_totals(metrics: DataFrame) -> DataFrame:
    """Sums by pool with a TOTAL row, and each in percent of all."""
    names = ("all", "lowf", "in", "unq", "com")
    out = metrics.rollup("pool").agg(*(F.sum(c).alias(c) for c in names))
    return out.select(F.coalesce("pool", F.lit("TOTAL")).alias("pool"), *names, *(F.round(F.col(c) * 100 / F.col("all"), 2).alias(f"{c}_pct") for c in names[1:]))


def aligned_haplotypes(reads: DataFrame) -> DataFrame:
    """(pool, patient, aln, nr) from reads that carry their aligned amplicon."""
    return reads.groupBy(*SAMPLE, F.col("amplicon_aln").alias("aln")).agg(F.count("*").alias("nr"))


def with_master(aligned: DataFrame) -> DataFrame:
    """Append the master (most reads, then first by sequence) and the differences to it.

    Of rows as wide as the master those are the columns that differ, gaps
    included; of others the least number of bases changed, put in or left out.
    Masters are found by a plain aggregate, so no sample's haplotypes pass one task.
    """
    masters = aligned.groupBy(*SAMPLE).agg(F.min_by("aln", F.struct(-F.col("nr"), F.col("aln"))).alias("master"))
    return aligned.join(small(masters), list(SAMPLE)).withColumn("nm", differences(F.col("aln"), F.col("master")))


def name_haplotypes(aligned: DataFrame, max_difs: int = 250) -> DataFrame:
    """(pool, patient, name, reads, freq, nm, seq): ranked by reads within each number of differences, gaps taken out."""
    return ranked_names(with_master(aligned), max_difs)


def ranked_names(measured: DataFrame, max_difs: int = 250) -> DataFrame:
    """The same from rows (pool, patient, aln, nr, nm) whose differences ``nm`` are known, as of real alignments."""
    kept = measured.where(F.col("nm") <= max_difs)
    totals = kept.groupBy(*SAMPLE).agg(F.sum("nr").alias("_all"))
    #: Within a sample and number of differences; of haplotypes that passed ``abundant`` there are some hundreds at most.
    order = Window.partitionBy(*SAMPLE, "nm").orderBy(F.desc("nr"), "aln")
    ranked = kept.withColumn("_rank", F.row_number().over(order)).join(small(totals), list(SAMPLE)).withColumn("freq", F.round(F.col("nr") * 100 / F.col("_all"), 2))
    return ranked.select(*SAMPLE, F.format_string("Hpl.%d.%04d", F.col("nm"), F.col("_rank")).alias("name"), F.col("nr").alias("reads"), "freq", "nm", F.replace(F.col("aln"), F.lit("-"), F.lit("")).alias("seq"))


def columns_of(aligned: DataFrame) -> DataFrame:
    """(pool, patient, pos, base, nr) of every alignment column."""
    return aligned.select(*SAMPLE, "nr", F.posexplode(F.split("aln", "")).alias("pos", "base")).select(*SAMPLE, (F.col("pos") + 1).alias("pos"), "base", "nr")


def gap_columns(aligned: DataFrame) -> DataFrame:
    """Per column: whether any and whether all haplotypes have a gap there."""
    return columns_of(aligned).groupBy(*SAMPLE, "pos").agg(F.bool_or(F.col("base") == "-").alias("any_gap"), F.bool_and(F.col("base") == "-").alias("all_gap")).where("any_gap")


def drop_gap_columns(aligned: DataFrame) -> DataFrame:
    """Alignments without the columns in which all haplotypes have a gap."""
    gone = gap_columns(aligned).where("all_gap").groupBy(*SAMPLE).agg(F.collect_set("pos").alias("gone"))
    kept = F.filter(F.split("aln", ""), lambda b, i: ~F.coalesce(F.array_contains("gone", i + 1), F.lit(False)))
    return aligned.join(gone, list(SAMPLE), "left").select(*SAMPLE, F.array_join(kept, "").alias("aln"), "nr")


def indel_profile(aligned: DataFrame) -> DataFrame:
    """Per column that has one: kind (2 insertion, 3 deletion against the master), reads with it, percent of the sample."""
    masters = with_master(aligned).where("nm = 0").select(*SAMPLE, F.posexplode(F.split("aln", "")).alias("_p", "m")).select(*SAMPLE, (F.col("_p") + 1).alias("pos"), "m")
    cells = columns_of(aligned).groupBy(*SAMPLE, "pos").agg(F.sum(F.when(F.col("base") == "-", F.col("nr")).otherwise(0)).alias("_del"), F.sum(F.when(F.col("base") != "-", F.col("nr")).otherwise(0)).alias("_ins"))
    out = cells.join(masters, [*SAMPLE, "pos"]).withColumn("kind", F.when(F.col("m") == "-", 2).when(F.col("_del") > 0, 3).otherwise(1)).where("kind > 1")
    return out.select(*SAMPLE, "pos", "kind", F.when(F.col("kind") == 2, F.col("_ins")).otherwise(F.col("_del")).alias("reads"), F.round(F.when(F.col("kind") == 2, F.col("_ins")).otherwise(F.col("_del")) * 100 / (F.col("_ins") + F.col("_del")), 4).alias("pct"))


def fasta_summary(named: DataFrame) -> DataFrame:
    """Per sample: haplotypes, most differences, the master's percent, reads."""
    return named.groupBy(*SAMPLE).agg(F.count("*").alias("hpl"), F.max("nm").alias("max_mut"), F.max("freq").alias("master_pct"), F.sum("reads").alias("reads"))


def coverage_summary(summary: DataFrame) -> DataFrame:
    """Six-number summaries of coverage, by pool and over all."""
    six = F.percentile("reads", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    out = summary.rollup("pool").agg(six.alias("x"), F.round(F.avg("reads"), 4).alias("mean"))
    return out.select(F.coalesce("pool", F.lit("TOTAL")).alias("pool"), *(F.round(F.col("x")[k], 6).alias(n) for k, n in enumerate(("min", "q1", "median", "q3", "max"))), "mean")


def equivalencies(named: DataFrame) -> DataFrame:
    """Sequences that two or more patients of a pool share, with the sorted ids."""
    return named.groupBy("pool", "seq").agg(F.count_distinct("patient").alias("patients"), F.array_join(F.array_sort(F.collect_set(F.concat_ws("|", F.format_string("%03d", F.col("patient").cast("int")), "name"))), ";").alias("ids")).where("patients > 1")


def genotype_distances(aligned: DataFrame, references: DataFrame) -> DataFrame:
    """(key, pool, patient, nr, type, distance) of each haplotype to each reference (pool, type, aln) of its pool; references are few."""
    every = aligned.join(small(references.select("pool", "type", F.col("aln").alias("ref"))), "pool")
    return every.select(F.concat_ws(":", "pool", F.col("patient").cast("string"), "aln").alias("key"), "pool", "patient", "nr", "type", differences(F.col("aln"), F.col("ref")).alias("distance"))


def genotype_call(distances: DataFrame) -> DataFrame:
    """(key, type, least, next, ratio) from (key, type, distance): the nearest type and how far the next one is.

    Of equal distances the first type wins; null distances aren't looked at;
    next is null where there is one type, ratio where the least is 0.
    """
    ranked = distances.where("distance is not null").groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("distance"), F.col("type")))).alias("d"))
    first, other = F.col("d")[0], F.get("d", F.lit(1))
    return ranked.select("key", first["type"].alias("type"), first["distance"].alias("least"), other["distance"].alias("next"), F.round(F.try_divide(other["distance"], first["distance"]), 6).alias("ratio"))


def genotype_means(wide: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(pool, the percents of the types): means over the patients, each of the same weight however many reads it has."""
    return wide.groupBy("pool").agg(*(F.round(F.avg(f"{t}_pct"), 2).alias(f"{t}_mean") for t in types))


def genotype_pivot(typed: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Reads by sample and type as columns, and percents of the row."""
    wide = typed.groupBy(*SAMPLE).pivot("type", list(types)).agg(F.sum("nr")).fillna(0, list(types))
    total = sum((F.col(t) for t in types), F.lit(0))
    return wide.select(*SAMPLE, *types, *(F.round(F.col(t) * 100 / total, 2).alias(f"{t}_pct") for t in types))


def genotype_mix(typed: DataFrame) -> DataFrame:
    """One line per sample: types by descending percent, as ``A 70.2%; B 29.8%``."""
    sums = typed.groupBy(*SAMPLE, "type").agg(F.sum("nr").alias("nr"))
    pct = F.round(F.col("nr") * 1000 / F.sum("nr").over(Window.partitionBy(*SAMPLE))).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("k"), "type", "p")))
    line = F.array_join(F.transform(ordered, lambda x: F.concat(x["type"], F.lit(" "), F.floor(x["p"] / 10).cast("string"), F.lit("."), (x["p"] % 10).cast("string"), F.lit("%"))), "; ")
    return sums.withColumn("p", pct).groupBy(*SAMPLE).agg(line.alias("mix"))
