"""Weighted rendezvous hashing of record keys into shards, on DataFrame functions only.

A key goes to the shard with the greatest ln(u) / weight, where u is a hash of
key and shard as a number between 0 and 1: each shard wins in proportion to
its weight, and whether it beats another one depends on these two alone.  So a
new shard, or a greater weight, takes keys only into that shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampliq.llm.common import text_or_empty, written
from ampliq.sources.shared import small

#: Shards of the query, all of one weight.
WEIGHTS = (1.0,) * 8
#: Hashed parts of a shard among which its rows are numbered; hex digits of a key's hash that name them.
PART_DIGITS = 3
#: Copies of one record that one task gives out.
COPIES = 1 << 16


def _hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def rendezvous(key: Column, weights: tuple[float, ...]) -> Column:
    """The shard of a key (text), from 0; of equal scores the lower shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scores = []
    for shard, weight in enumerate(weights):
        number = F.conv(F.substring(_hash(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
        scores.append(F.struct((F.log((number + 0.5) / float(1 << 52)) / weight).alias("score"), F.lit(-shard).alias("shard")))
    return -F.array_max(F.array(*scores))["shard"]


def key_of(record_id: Column) -> Column:
    """A record's key as text; null is the empty key."""
    return F.coalesce(record_id.cast("string"), F.lit(""))


def with_shard(records: DataFrame, record_id: str, weights: tuple[float, ...] = WEIGHTS, name: str = "shard") -> DataFrame:
    """``records`` with their shard, without a shuffle; a column of that name is replaced."""
    return records.withColumn(name, rendezvous(key_of(records[record_id]), weights))


def moves(records: DataFrame, record_id: str, before: tuple[float, ...], after: tuple[float, ...]) -> DataFrame:
    """(from_shard, to_shard, records) when the weights change: what a change of the shard count has to copy."""
    key = key_of(records[record_id])
    return records.select(rendezvous(key, before).alias("from_shard"), rendezvous(key, after).alias("to_shard")).groupBy("from_shard", "to_shard").agg(F.count("*").alias("records"))


def shard_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, added: float = 1.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    size is the UTF-8 bytes of the text plus 1, a null text being empty.  The
    law is ``key``: doc_id and the shards decide; grown_shard is the shard once
    one of weight ``added`` joins.  Slots count a shard's rows from 0 without a
    gap, in the order of hashed part, id, size and checksum; rows equal in these
    take neighbouring slots, so reruns agree.  Null ids share the empty key;
    repeated ids share a shard, each row with a slot of its own; other columns
    are ignored; an empty table gives an empty result.

    The text is read once and reduced to a few numbers, which are summed by
    equal rows before they are shuffled.  Rows are numbered within some
    thousands of parts of each shard, parts by their counts; equal rows are
    given out COPIES at a time, so no id's rows need one task.
    """
    body = text_or_empty(docs[text])
    sized = docs.select(docs[doc_id].alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = sized.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_n"))
    key = key_of(F.col("doc_id"))
    rows = rows.withColumns({"shard": rendezvous(key, weights), "grown_shard": rendezvous(key, (*weights, added)), "_part": F.substring(_hash(key), 1, PART_DIGITS)})
    rows = written(rows, "shard-rows")
    parts = rows.groupBy("shard", "_part").agg(F.sum("_n").alias("_rows"))
    before = lambda n, by, order: F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("shard", "_part", before("_rows", ["shard"], ["_part"]).alias("_start"))  # at most 16 ** PART_DIGITS rows a shard
    placed = rows.withColumn("_own", before("_n", ["shard", "_part"], ["doc_id", "size", "text_crc32"])).join(small(parts), ["shard", "_part"])
    placed = placed.withColumn("_first", F.col("_start") + F.col("_own"))
    few = placed.where(F.col("_n") <= COPIES).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    many = placed.where(F.col("_n") > COPIES).withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / COPIES)))).repartition("doc_id", "_block")
    many = many.withColumn("_copy", F.explode(F.sequence(F.col("_block") * COPIES, F.least((F.col("_block") + 1) * COPIES, F.col("_n")) - 1))).drop("_block")
    return few.unionByName(many).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_copy")).alias("slot"), "grown_shard")


def _score(shard: str, weight: str) -> str:
    return f"ln((('0x' || substr(md5(key || ':' || {shard}), 1, 13))::BIGINT + 0.5) / 4503599627370496) / {weight}"


def _chosen(weights: tuple[float, ...]) -> str:
    return f"-list_max(list_transform(range({len(weights)}), lambda i: {{'score': {_score('i', str(list(weights)) + '[i + 1]')}, 'shard': -i}})).shard"


#: A checksum by half bytes: low one first, each step looks up one of 16 values.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(regexp_replace(hex(encode(body)), '(.)(.)', '\\2\\1', 'g'), ''), lambda c: CAST(instr('123456789ABCDEF', c) AS BIGINT))),
 lambda crc, b: xor(crc >> 4, tab[CAST((xor(crc, b) & 15) + 1 AS INT)])))"""
_TAB = "list_transform(range(16), lambda i: list_reduce([i, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS body, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents),
c AS (SELECT doc_id, key, strlen(body) + 1 AS size, CASE WHEN body = '' THEN 0 ELSE {_CRC} END AS text_crc32 FROM d, (SELECT {_TAB} AS tab)),
s AS (SELECT *, {_chosen(WEIGHTS)} AS shard, {_chosen((*WEIGHTS, 1.0))} AS grown_shard FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY substr(md5(key), 1, {PART_DIGITS}), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(grown_shard AS INT) AS grown_shard FROM s"""


#: Weights before and after a fifth shard of double weight joins and the first one's weight is halved.
BEFORE, AFTER = (4.0, 2.0, 1.0, 1.0), (2.0, 2.0, 1.0, 1.0, 2.0)
MOVES_ORACLE = f"""SELECT CAST(from_shard AS INT) AS from_shard, CAST(to_shard AS INT) AS to_shard, count(*) AS records FROM
 (SELECT {_chosen(BEFORE)} AS from_shard, {_chosen(AFTER)} AS to_shard FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents)) GROUP BY ALL"""
