"""Samples, tags and primers as tables: lookups that the stages share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bases that adapters and tags add on both sides of an amplicon in raw reads.
OVERHANG = 2 * (20 + 10)


def inner_positions(primers: DataFrame) -> DataFrame:
    """``primers`` with FW.tpos and RV.tpos, the first positions inside the primers; what the file says there isn't trusted."""
    return primers.withColumns({"FW.tpos": F.col("`FW.pos`") + F.length("`Primer.FW`"), "RV.tpos": F.col("`RV.pos`") - F.length("`Primer.RV`")})


def used_primers(primers: DataFrame, samples: DataFrame) -> DataFrame:
    """Primers that some sample names."""
    return primers.join(samples.select(F.col("`Primer.ID`").alias("Ampl.Nm")), "Ampl.Nm", "left_semi")


def expected_length(samples: DataFrame, primers: DataFrame, raw: bool = False) -> DataFrame:
    """(pool, expected): the longest amplicon of each pool's primers, for ``raw`` reads with adapters and tags."""
    wide = samples.join(primers, F.col("`Primer.ID`") == F.col("`Ampl.Nm`")).groupBy(F.col("`Pool.Nm`").alias("pool"))
    return wide.agg((F.max(F.col("`RV.pos`") - F.col("`FW.pos`") + 1) + (OVERHANG if raw else 0)).alias("expected"))


def resolved_samples(samples: DataFrame, tags: DataFrame, primers: DataFrame) -> DataFrame:
    """(pool, patient, mid_seq, fw_primer, rv_primer, mid_order) as the searches take it, from the tables by name.

    Names are compared as text.  ``tags`` may be per pool (column Pool.Nm) or
    of the whole run.  The order of the tags is that of their numbers.
    """
    s, t = samples.alias("s"), tags.alias("t")
    same = F.col("s.MID").cast("string") == F.col("t.`MID.ID`").cast("string")
    if "Pool.Nm" in tags.columns:
        same = same & (F.col("s.`Pool.Nm`") == F.col("t.`Pool.Nm`"))
    both = s.join(t, same).join(primers.alias("p"), F.col("s.`Primer.ID`") == F.col("p.`Ampl.Nm`"))
    order = F.row_number().over(Window.partitionBy("pool").orderBy(F.expr("try_cast(_mid AS int)").asc_nulls_last(), "_mid"))
    out = both.select(F.col("s.`Pool.Nm`").alias("pool"), F.col("s.`Patient.ID`").alias("patient"), F.col("t.`MID.Seq`").alias("mid_seq"), F.col("p.`Primer.FW`").alias("fw_primer"), F.col("p.`Primer.RV`").alias("rv_primer"), F.col("s.MID").alias("_mid"))
    return out.withColumn("mid_order", order).drop("_mid")


def pool_of(results: DataFrame, samples: DataFrame) -> DataFrame:
    """``results`` (patient, amplicon, ...) with the pool of the first sample of that patient and amplicon, null if there is none."""
    first = samples.groupBy(F.col("`Patient.ID`").alias("_p"), F.col("`Primer.ID`").alias("_a")).agg(F.min_by("`Pool.Nm`", F.struct(F.expr("try_cast(MID AS int)"), F.col("`Pool.Nm`"))).alias("pool"))
    return results.join(first, (F.col("patient").cast("string") == F.col("_p")) & (F.col("amplicon") == F.col("_a")), "left").drop("_p", "_a")


def with_region(results: DataFrame, primers: DataFrame) -> DataFrame:
    """``results`` (amplicon, ...) with the amplicon's region, null if it has none."""
    return results.join(primers.select(F.col("`Ampl.Nm`").alias("amplicon"), F.col("Region").alias("region")), "amplicon", "left")


def five_numbers(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, min, q1, median, q3, max) of ``value``, as a box plot shows it."""
    out = rows.groupBy(by).agg(F.count(value).alias("n"), F.percentile(value, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("x"))
    return out.select(by, "n", *(F.round(F.col("x")[k], 6).alias(name) for k, name in enumerate(("min", "q1", "median", "q3", "max"))))
