"""Deterministic amplicon reads derived from the ``events`` table, by SQL that Spark and DuckDB both accept."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampliq.functions.dna import reverse_complement
from ampliq.sources.shared import once, small

RECIPE = Path(__file__).with_name("derived_reads.sql").read_text()


def derived_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, pool, patient, true_strand, hap, mid_seq, fw_primer, rv_primer, master_seq, amplicon_aln, seq, qual.

    Written once per session as Parquet, as a run's reads would lie in files:
    the queries then scan only the columns they need.  All but the qualities is
    decided by a few properties of an event (``_kind``), so RECIPE is worked out
    for one event of each kind, at most some 40 thousand rows for any number of
    reads, and reads take it by a join.  Two narrow columns of ``events`` become
    some five hundred bytes a read, so they are dealt to all tasks first,
    however few row groups their file has.
    """
    def events() -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")

    def kinds() -> DataFrame:
        one = events().groupBy(_kind().alias("_kind")).agg(F.min(F.struct("event_id", "user_id")).alias("x"))
        one = one.select("_kind", "x.event_id", "x.user_id")
        made = spark.sql(RECIPE.replace("FROM events", "FROM {events}"), events=one)
        return made.drop("qual").withColumn("_kind", _kind("read_id", "patient")).drop("read_id")

    def build() -> DataFrame:
        table = events()
        spread = max(table.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = table.repartition(spread, "event_id").select(F.col("event_id").alias("read_id"), _kind().alias("_kind"))
        letters = F.concat(*(F.md5(F.concat(F.lit(k), F.col("read_id").cast("string"))) for k in ("q1", "q2")))
        signs = F.when(F.col("read_id") % 3 == 0, F.translate(letters, _HEX, "#>?@ABCDEFGHIJJJ")).otherwise(F.translate(letters, _HEX, "?@@AABCDEFGHIJJJ"))
        made = once(spark, sf_dir, "amplicons", kinds)
        qual = F.substring(F.repeat(signs, F.lit(5)), F.lit(1), F.length("seq")).alias("qual")
        return dealt.join(small(made), "_kind").select("read_id", *(c for c in made.columns if c != "_kind"), qual)

    return once(spark, sf_dir, "reads", build)


_HEX = "0123456789abcdef"


def _kind(event: str = "event_id", user: str = "user_id") -> Column:
    """A number for what RECIPE looks at in an event besides its qualities: patient, pool and strand, haplotype, substitutions and cut; never null."""
    e = F.col(event)
    spot = e * 7919 % 101
    hap = F.when(spot < 50, 0).when(spot < 70, 1).when(spot < 80, 2).otherwise(3 + spot - 80)
    parts = [(F.coalesce(F.col(user) % 12 + 11, F.lit(31)), 32), (F.coalesce(e % 4 + 3, F.lit(7)), 8), (F.coalesce(hap, F.lit(31)), 32),
             (F.when(e % 11 == 3, 1).when(e % 13 == 7, 2).otherwise(0), 3), (F.when(e % 23 == 2, 1).when(e % 29 == 4, 2).otherwise(0), 3), (F.when(e % 19 == 5, 1).otherwise(0), 2), (F.when(e % 17 == 9, 1).otherwise(0), 2)]
    out = F.lit(0).cast("long")
    for value, width in parts:
        out = out * width + value
    return out


def derived_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pool, read_id, seq, qual) of first and second mates, cut from both ends of each read and written once per session.

    Every seventh second mate is another sequence; some have one wrong base of
    low quality in the overlap.
    """
    def first() -> DataFrame:
        return derived_reads(spark, sf_dir).select("pool", "read_id", F.substring("seq", 1, 180).alias("seq"), F.substring("qual", 1, 180).alias("qual"))

    def second() -> DataFrame:
        c, size = F.col, F.length("seq")
        start, wrong = F.greatest(size - 179, F.lit(1)), (c("read_id") % 5 == 1) & (size > 180)
        whole = F.when(wrong, F.concat(F.substring("seq", 1, 149), F.translate(F.substring("seq", 150, 1), "ACGTN", "CATGA"), F.substring(c("seq"), F.lit(151), size))).otherwise(c("seq"))
        high = F.when(wrong, F.concat(F.repeat(F.lit("I"), F.lit(149)), F.lit("#"), F.repeat(F.lit("I"), size - 150))).otherwise(F.repeat(F.lit("I"), size))
        foreign = F.translate(F.repeat(F.md5(F.concat(F.lit("x"), c("read_id").cast("string"))), 5), "0123456789abcdef", "ACGTACGTACGTACGT")
        mate = F.when(c("read_id") % 7 == 0, foreign).otherwise(reverse_complement(F.substring(whole, start, F.lit(180))))
        qual = F.when(c("read_id") % 7 == 0, F.repeat(F.lit("I"), F.length(foreign))).otherwise(F.reverse(F.substring(high, start, F.lit(180))))
        return derived_reads(spark, sf_dir).select("pool", "read_id", mate.alias("seq"), qual.alias("qual"))

    return once(spark, sf_dir, "mates-1", first), once(spark, sf_dir, "mates-2", second)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pool and patient with its tag, its primers and its place in the pool's order; written once, so that its size is known."""
    def build() -> DataFrame:
        distinct = derived_reads(spark, sf_dir).select("pool", "patient", "mid_seq", "fw_primer", "rv_primer").distinct()
        return distinct.withColumn("mid_order", F.row_number().over(Window.partitionBy("pool").orderBy("patient")))

    return once(spark, sf_dir, "samples", build)


def sample_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples as a sample sheet has them: all text, tags and primers by name."""
    c = F.col
    return samples(spark, sf_dir).select(
        c("patient").cast("string").alias("Patient.ID"), c("mid_order").cast("string").alias("MID"), F.concat(F.lit("AMP."), "pool").alias("Primer.ID"),
        F.when(c("pool") == "POOLA", "S").otherwise("X").alias("Region"), F.lit("ref").alias("RefSeq.ID"), c("pool").alias("Pool.Nm"))


def tag_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags by name; a tag of the second pool is numbered on from those of the first, as each pool has tags of its own."""
    return samples(spark, sf_dir).select(F.col("pool").alias("Pool.Nm"), F.col("mid_order").cast("string").alias("MID.ID"), F.col("mid_seq").alias("MID.Seq"))


def primer_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One amplicon per pool, at made-up positions of a genome."""
    c = F.col
    at = F.when(c("pool") == "POOLA", 1255).otherwise(2844)
    one = samples(spark, sf_dir).groupBy("pool").agg(F.min("fw_primer").alias("fw"), F.min("rv_primer").alias("rv"))
    return one.select(F.concat(F.lit("AMP."), "pool").alias("Ampl.Nm"), F.when(c("pool") == "POOLA", "S").otherwise("X").alias("Region"), c("fw").alias("Primer.FW"), c("rv").alias("Primer.RV"),
                      at.alias("FW.pos"), (at + 263).alias("RV.pos"), F.lit(0).alias("FW.tpos"), F.lit(0).alias("RV.tpos"), F.lit(1).alias("Aa.ipos"), F.lit(74).alias("Aa.lpos"))
