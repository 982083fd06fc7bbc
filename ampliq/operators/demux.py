"""Demultiplexing by sample tag and by primer.

Identical reads are collapsed first, so that each distinct sequence is searched
once and carries its count ``n``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliq.functions.dna import first_match, reverse_complement
from ampliq.sources.shared import small


def collapse(reads: DataFrame) -> DataFrame:
    return reads.groupBy("pool", "seq").agg(F.count("*").alias("n"))


def tag_seeds(tags: DataFrame, most: int, size: int) -> DataFrame:
    """The inverted index of tags: (pool, seed, shift) and the tag's columns, a row for each of a tag's ``most`` + 1 pieces; ``size`` characters of a piece are its seed.

    A read that holds a tag with at most ``most`` substitutions holds one of its
    pieces as it stands, ``shift`` places on.
    """
    part = F.floor(F.length("mid_seq") / (most + 1)).cast("int")
    pieces = F.array(*(F.struct(F.substring(F.col("mid_seq"), k * part + 1, F.lit(size)).alias("seed"), (k * part).alias("shift")) for k in range(most + 1)))
    return tags.select("pool", "patient", "mid_seq", "mid_order", F.explode(pieces).alias("x")).select("pool", "x.seed", "x.shift", "patient", "mid_seq", "mid_order")


def _candidates(collapsed: DataFrame, samples: DataFrame, most: int, start: int, end: int, longer_than: int) -> DataFrame:
    """``collapsed`` reads with patient, mid_order and pos of tags that they hold, and one row of each read with nulls there.

    The pieces of a read's window meet the index of tags by an equi-join; what
    meets is verified.  The index is broadcast if it is small, so reads stay
    where their collapse has put them.
    """
    tags = samples.select("pool", "patient", "mid_seq", "mid_order").where(F.length("mid_seq") > 0)
    shortest = tags.agg(F.min(F.length("mid_seq"))).first()[0] or 0
    long = collapsed.where(F.length("seq") > longer_than)
    window = F.substring("seq", start, end - start + 1)
    size = shortest // (most + 1)
    if not size:  # a tag without pieces: any read may hold it
        found = long.join(small(tags), "pool", "left").withColumn("pos", F.explode(F.array(first_match(window, F.col("mid_seq"), most) + start - 1)))
        return found.select("pool", "seq", "n", F.when(F.col("pos").isNotNull(), F.col("patient")).alias("patient"), F.when(F.col("pos").isNotNull(), F.col("mid_order")).alias("mid_order"), "pos")
    #: Place 0 stands for the read itself; it meets no seed and is kept.
    spots = F.transform(F.sequence(F.lit(0), F.least(F.length(window), F.lit(end)) - size + 1), lambda at: F.struct(at.alias("at"), F.when(at > 0, F.substring(window, at, F.lit(size))).alias("seed")))
    pieces = long.withColumn("x", F.explode(spots)).select("pool", "seq", "n", F.col("x.at").alias("at"), F.col("x.seed").alias("seed"))
    met = pieces.join(small(tag_seeds(tags, most, size)), ["pool", "seed"], "left").where("at = 0 or shift is not null")
    place = F.col("at") - F.col("shift")
    held = F.substring(window, place, F.length("mid_seq"))
    fits = (place >= 1) & (F.length(held) == F.length("mid_seq"))
    wrong = F.size(F.filter(F.sequence(F.lit(1), F.length("mid_seq")), lambda i: F.substring(held, i, F.lit(1)) != F.substring(F.col("mid_seq"), i, F.lit(1))))
    return met.where((F.col("at") == 0) | (fits & (wrong <= most))).select("pool", "seq", "n", "patient", "mid_order", (place + start - 1).alias("pos"))


def mid_hits(collapsed: DataFrame, samples: DataFrame, most: int = 1, start: int = 1, end: int = 40, longer_than: int = 150) -> DataFrame:
    """(pool, seq, n, patient, mid_order, pos): every tag of its pool that a read holds in positions start to end, where it begins first.

    Work grows with the pieces that reads and tags share, not with reads times
    tags; the rest of a read is looked at for these alone.
    """
    found = _candidates(collapsed, samples, most, start, end, longer_than).where("pos is not null")
    return found.groupBy("pool", "seq", "patient", "mid_order").agg(F.max("n").alias("n"), F.min("pos").alias("pos")).select("pool", "seq", "n", "patient", "mid_order", "pos")


def assign_mid(collapsed: DataFrame, samples: DataFrame, most: int = 1, start: int = 1, end: int = 40, longer_than: int = 150) -> DataFrame:
    """(pool, seq, n, patient): the first tag in its pool's order that a read holds, else null; short reads are left out."""
    found = _candidates(collapsed, samples, most, start, end, longer_than)
    return found.groupBy("pool", "seq").agg(F.max("n").alias("n"), F.min_by("patient", "mid_order").alias("patient"))


def mid_counts(assigned: DataFrame) -> DataFrame:
    """Reads by pool and patient; patient -1 holds those without a tag."""
    return assigned.groupBy("pool", F.coalesce("patient", F.lit(-1)).alias("patient")).agg(F.sum("n").alias("reads"))


def pool_mid_coverage(collapsed: DataFrame, assigned: DataFrame) -> DataFrame:
    """pool, tot_reads, no_mid, mid_reads."""
    total = collapsed.groupBy("pool").agg(F.sum("n").alias("tot_reads"))
    split = assigned.groupBy("pool").agg(F.sum(F.when(F.col("patient").isNull(), F.col("n")).otherwise(0)).alias("no_mid"), F.sum(F.when(F.col("patient").isNotNull(), F.col("n")).otherwise(0)).alias("mid_reads"))
    return total.join(split, "pool", "left").select("pool", "tot_reads", F.coalesce("no_mid", F.lit(0)).alias("no_mid"), F.coalesce("mid_reads", F.lit(0)).alias("mid_reads"))


def match_primers(assigned: DataFrame, samples: DataFrame, most: int = 3, min_len: int = 180, start: int = 1, end: int = 100, overhang: bool = False) -> DataFrame:
    """Append short, strand, pos5, pos3 and trimmed to reads that have a patient.

    A forward primer at the 5' end decides for ``fw`` even if the 3' search then
    fails; only other reads are tried as ``rv``.  Those are trimmed, must stay
    longer than ``end`` + 5, and are turned round before the forward primer is
    searched.  ``trimmed`` is null unless both ends were found.  With
    ``overhang`` a primer may pass the ends of the window that is searched, the
    places outside counting as substitutions; pos5 and pos3 may then be below 1.
    """
    primers = samples.select("pool", "patient", "fw_primer", "rv_primer")
    #: The search costs far more than its rows weigh, so partitions aren't left to be merged by their bytes.
    spread = int(assigned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = assigned.where("patient is not null").join(small(primers), ["pool", "patient"]).repartition(spread, "seq")
    find = lambda window, primer: first_match(window, primer, most, True, overhang)
    #: An explode of one value each, so that a search is computed once and planned by itself.
    once = lambda df, name, value: df.withColumn(name, F.explode(F.array(value)))
    c, head = F.col, F.substring("seq", start, end - start + 1)
    out = out.withColumn("short", F.length("seq") <= min_len)
    out = once(out, "_fw5", F.when(~c("short"), find(head, c("fw_primer"))))
    out = once(out, "_rv5", F.when(~c("short") & c("_fw5").isNull(), find(head, c("rv_primer"))))
    #: After the 5' primer, in forward orientation; the other primer and the part in which it is searched.
    forward = c("_fw5").isNotNull()
    rest = F.substring("seq", F.coalesce(c("_fw5") + F.length("fw_primer"), c("_rv5") + F.length("rv_primer")) + start - 1, F.length("seq"))
    turned = F.when(F.length(rest) > end + 5, reverse_complement(rest))
    out = once(out, "_rest", F.when(forward, rest).when(c("_rv5").isNotNull(), turned))
    inner = max(start - 5, 1)
    low = F.when(forward, F.greatest(F.length("_rest") - end, F.lit(1))).otherwise(inner)
    part = F.substring(c("_rest"), low, F.when(forward, end + 1).otherwise(end + 5 - inner + 1))
    out = once(out, "pos3", find(part, F.when(forward, reverse_complement(c("rv_primer"))).otherwise(c("fw_primer"))) + low - 1)
    cut = F.when(forward, F.substring(c("_rest"), F.lit(1), c("pos3") - 1)).otherwise(F.substring(c("_rest"), c("pos3") + F.length("fw_primer"), F.length("_rest")))
    return out.select("pool", "patient", "seq", "n", "short", F.when(forward, "fw").when(c("_rv5").isNotNull(), "rv").alias("strand"), (F.coalesce("_fw5", "_rv5") + start - 1).alias("pos5"), "pos3", F.nullif(cut, F.lit("")).alias("trimmed"))


def primer_counters(matched: DataFrame) -> DataFrame:
    """Per pool and patient: tot_reads, shorts, fw_match, rv_match, fw_fn_match, rv_fn_match, fn_reads."""
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    c, full = F.col, F.col("trimmed").isNotNull()
    return matched.groupBy("pool", "patient").agg(
        F.sum("n").alias("tot_reads"), total(c("short")).alias("shorts"), total(c("strand") == "fw").alias("fw_match"), total(c("strand") == "rv").alias("rv_match"),
        total((c("strand") == "fw") & full).alias("fw_fn_match"), total((c("strand") == "rv") & full).alias("rv_fn_match"), total(full).alias("fn_reads"))


def primer_by_patient(counters: DataFrame) -> DataFrame:
    return counters.groupBy("patient").agg(F.sum("fw_fn_match").alias("fw"), F.sum("rv_fn_match").alias("rv"))


def pool_primer_yield(counters: DataFrame) -> DataFrame:
    out = counters.groupBy("pool").agg(F.sum("tot_reads").alias("mid_reads"), F.sum("fn_reads").alias("primer_reads"))
    return out.withColumn("pct", F.round(F.col("primer_reads") * 100 / F.col("mid_reads"), 4))


def collapse_haplotypes(matched: DataFrame) -> DataFrame:
    """(pool, patient, strand, seq, nr)."""
    return matched.where("trimmed is not null").groupBy("pool", "patient", "strand", F.col("trimmed").alias("seq")).agg(F.sum("n").alias("nr"))


def haplotype_files(haplotypes: DataFrame) -> DataFrame:
    """Reads, haplotypes and mean length by pool, patient and strand."""
    return haplotypes.groupBy("pool", "patient", "strand").agg(F.sum("nr").alias("reads"), F.count("*").alias("hpls"), F.round(F.sum(F.length("seq") * F.col("nr")) / F.sum("nr"), 1).alias("len_mean"))


def haplotype_lengths(haplotypes: DataFrame, least: int = 10) -> DataFrame:
    """Reads by pool, patient, strand and length, from ``least`` reads on."""
    return haplotypes.groupBy("pool", "patient", "strand", F.length("seq").alias("len")).agg(F.sum("nr").alias("reads")).where(F.col("reads") >= least)


def top_haplotype(haplotypes: DataFrame) -> DataFrame:
    """The haplotype of most reads of each strand, of equal ones the first by sequence: an aggregate, one row a task and strand."""
    keys = ("pool", "patient", "strand")
    best = haplotypes.groupBy(*keys).agg(F.min_by(F.struct("seq", "nr"), F.struct((-F.col("nr")).alias("k"), F.col("seq"))).alias("x"))
    return best.select(*keys, "x.seq", "x.nr")
