"""Reads that arrive over time: the stateless filter and running counts per pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ampliq.operators.quality import filter_q30

READS = T.StructType([T.StructField("pool", T.StringType()), T.StructField("read_id", T.LongType()), T.StructField("seq", T.StringType()), T.StructField("qual", T.StringType())])


def stream_reads(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_counts(reads: DataFrame, max_pct: float = 0.05) -> DataFrame:
    """Reads that pass the filter, by pool; for output modes complete and update."""
    return filter_q30(reads, max_pct).groupBy("pool").count()


def start_counts(spark: SparkSession, path: str, name: str, checkpoint: str) -> StreamingQuery:
    out = running_counts(stream_reads(spark, path)).writeStream.outputMode("complete").format("memory").queryName(name)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
