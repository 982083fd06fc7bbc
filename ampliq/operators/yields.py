"""Yield funnel over the pipeline's stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STAGES = ("raw", "flash", "fq30", "mid", "primer", "filt", "ints")


def funnel(stages: dict[str, DataFrame]) -> DataFrame:
    """Wide funnel by pool from (pool, n) frames, with a TOTAL row; stages that lack a pool count 0."""
    named = [df.groupBy("pool").agg(F.sum("n").alias(name)) for name, df in stages.items()]
    wide = reduce(lambda a, b: a.join(b, "pool", "left"), named).fillna(0)
    return wide.rollup("pool").agg(*(F.sum(c).alias(c) for c in stages)).withColumn("pool", F.coalesce("pool", F.lit("TOTAL")))


def read_counts(scored: DataFrame, max_pct: float = 0.05) -> DataFrame:
    """(pool, raw, flash, fq30) in one pass over reads with fraction_below; merged reads are the raw ones here."""
    return scored.groupBy("pool").agg(F.count("*").alias("raw"), F.count("*").alias("flash"), F.count_if(F.col("fraction_below") <= max_pct).alias("fq30"))


def match_counts(matched: DataFrame) -> DataFrame:
    """(pool, mid, primer) in one pass over matched reads."""
    return matched.groupBy("pool").agg(F.sum("n").alias("mid"), F.sum(F.when(F.col("trimmed").isNotNull(), F.col("n")).otherwise(0)).alias("primer"))


def join_counts(parts: list[DataFrame], stages: tuple[str, ...] = STAGES) -> DataFrame:
    """Wide funnel by pool from frames that each hold some of the stages, with a TOTAL row; pools are those of the first."""
    wide = reduce(lambda a, b: a.join(b, "pool", "left"), parts).fillna(0)
    return wide.rollup("pool").agg(*(F.sum(c).alias(c) for c in stages)).withColumn("pool", F.coalesce("pool", F.lit("TOTAL")))


def long_funnel(wide: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """(pool, stage_no, stage, n, step_pct, raw_pct): each stage against the one before and against the first."""
    rows = wide.select("pool", F.posexplode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).alias("n")) for s in stages))).alias("stage_no", "x")).select("pool", "stage_no", "x.*")
    order = Window.partitionBy("pool").orderBy("stage_no")
    before, first = F.lag("n").over(order), F.first("n").over(order)
    return rows.select("pool", "stage_no", "stage", "n", F.round(F.when(before > 0, F.col("n") * 100 / before), 2).alias("step_pct"), F.round(F.when(first > 0, F.col("n") * 100 / first), 2).alias("raw_pct"))


def coverage_log(final: DataFrame) -> DataFrame:
    """log10 of each sample's final reads, 0 for none."""
    return final.withColumn("log_reads", F.round(F.when(F.col("reads") > 0, F.log10("reads")).otherwise(0.0), 6))
