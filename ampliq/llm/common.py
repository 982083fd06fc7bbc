"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliq.functions.dna import let
from ampliq.sources.shared import delete, shared_dir

__all__ = ["CHARACTER", "CHUNK", "SPACE", "WORD", "count_words", "discard", "fold", "let", "maybe_in", "read_table", "scratch", "shared_dir", "text_or_empty", "written"]

#: A word is a run of characters other than six.
SPACE, CHARACTER = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
WORD = f"{CHARACTER}+"


_scratch: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``written`` writes within goes to a folder of its own, which is deleted in the end."""
    _scratch.append(f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        delete(spark, _scratch.pop())


def written(df: DataFrame, name: str, *consumed: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; then delete ``consumed``.

    Cuts the lineage like ``checkpoint()`` but keeps the columnar, compressed
    form, so later passes read only the columns they need.  ``consumed`` are
    results of this function that no later step reads.
    """
    path = f"{_scratch[-1] if _scratch else shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    discard(*consumed)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*consumed: DataFrame) -> None:
    """Delete what ``written`` wrote."""
    for df in consumed:
        delete(df.sparkSession, df.written_to)


#: A filter's bits: at most so many, BITS_A_KEY for each key below that; CHUNK of them are one row.
MOST_BITS, BITS_A_KEY, CHUNK = 1 << 28, 10, 1 << 15


def maybe_in(df: DataFrame, keys: DataFrame, *columns: str, flag: str = "_maybe") -> DataFrame:
    """``df`` with a boolean: false only for rows whose ``columns`` are no row of ``keys``.

    A filter of one hash per key, built as bitmaps and broadcast: about a tenth
    of the other rows are true too (more beyond MOST_BITS / BITS_A_KEY keys),
    so an exact join must follow, which then shuffles few rows.  What is
    broadcast is at most MOST_BITS / 8 bytes, 32 MB, however many keys there are.
    """
    bits = CHUNK
    while bits < min(MOST_BITS, BITS_A_KEY * keys.count()):
        bits *= 2
    at = F.pmod(F.xxhash64(*columns), F.lit(bits)) + 1
    maps = keys.select(F.bitmap_bucket_number(at).alias("_chunk"), F.bitmap_bit_position(at).alias("_bit")).groupBy("_chunk").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    spot = F.pmod(F.col("_at") - 1, F.lit(CHUNK)).cast("int")
    byte = F.conv(F.hex(F.substring("_map", F.floor(spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.call_function("shiftright", byte, spot % 8).bitwiseAND(F.lit(1)) == 1
    joined = df.withColumn("_at", at).withColumn("_chunk", F.bitmap_bucket_number("_at")).join(F.broadcast(maps), "_chunk", "left")
    return joined.withColumn(flag, F.coalesce(found, F.lit(False))).drop("_at", "_chunk", "_map")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def count_words(text: Column) -> Column:
    """Words of ``text``: each becomes one character, with what is between it and the next; what is before the first goes."""
    return F.length(F.regexp_replace(F.regexp_replace(text, f"{WORD}{SPACE}*", "x"), f"^{SPACE}+", "")).cast("long")


def fold(doc_id: str | Column) -> Column:
    """Fold 0 to 3 of a document: crc32 of the decimal id, modulo 4 (null id: 0)."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4, F.lit(0))
