"""Quality profiles over runs: counts by file that are stored once and merge exactly, so that only new files are read."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampliq.operators.quality import QUANTILES, position_counts, profile_of_counts
from ampliq.sources.sequences import file_fields, read_fastq
from ampliq.sources.shared import exists

COUNTS = T.StructType([T.StructField("given", T.StringType()), T.StructField("pool", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("q", T.IntegerType()), T.StructField("n", T.LongType())])


def stored_counts(spark: SparkSession, store: str) -> DataFrame:
    """(given, pool, pos, q, n) of all files counted so far; ``given`` is the path by which a file or folder was added."""
    if not exists(spark, store):
        return spark.createDataFrame([], COUNTS)
    return spark.read.schema(COUNTS).option("recursiveFileLookup", True).parquet(store)


def add_files(spark: SparkSession, store: str, paths: list[str]) -> list[str]:
    """Count the FASTQ files at ``paths`` that the store doesn't have yet; returns these.

    Pools come from the files' names.  What is added lies in a folder named by
    its paths, which is replaced whole: an addition that broke off and is made
    again counts nothing twice.  A path without a record leaves no count and is
    looked at again.
    """
    known = {r.given for r in stored_counts(spark, store).select("given").distinct().toLocalIterator()}  # one row a path
    new = sorted(set(paths) - known)
    for path in new:
        counts = position_counts(file_fields(read_fastq(spark, path)))
        name = hashlib.sha256(path.encode()).hexdigest()[:32]
        counts.select(F.lit(path).alias("given"), "pool", F.col("pos").cast("int").alias("pos"), F.col("q").cast("int").alias("q"), "n").write.mode("overwrite").parquet(f"{store}/added-{name}")
    return new


def stored_profile(spark: SparkSession, store: str, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Exact quantiles by pool and position over all files of the store, without reading these."""
    counts = stored_counts(spark, store).groupBy("pool", "pos", "q").agg(F.sum("n").alias("n"))
    return profile_of_counts(counts, quantiles)
