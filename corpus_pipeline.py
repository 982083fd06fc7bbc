"""A training-data pipeline over ``documents``: filter, deduplicate, cut repeats, mix, encode.

Every stage reads what its predecessor wrote and returns the columns of
documents; the last returns the encoded documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliq.llm import bpe, mixing, ngram_join, quality_model, suffix_dedup
from ampliq.llm.common import maybe_in, read_table, scratch, shared_dir, written

#: Training and the choice of documents to repeat aren't expressible in SQL.
ORACLE_SQL = None


def _packed(docs: DataFrame, *without: str) -> DataFrame:
    """doc_id, text, source and all columns but ``without`` as one struct, so that no name of a column can clash."""
    return docs.select("doc_id", "text", "source", F.struct(*(docs[c] for c in docs.columns if c not in without)).alias("row"))


def _unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    return rows.select(*(changed.get(c, F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A verdict depends on the text alone, so equal texts are kept or go
    together; null and empty texts are judged as texts without words; repeated
    rows and null ids stay rows; other columns, whatever their names, are
    carried along; an empty table gives an empty result.  Texts are scored in
    the pass that reads them and are not shuffled.
    """
    scored = quality_model.classify(_packed(docs), read_table(spark, sf_dir, "labels"), keep=("row",))
    return _unpacked(scored.where("predicted = 1"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays; texts without a word (null, empty, blank) all stay.

    The one that stays has the least id (nulls last), of its rows those of the
    least name of the words, and of these the least hash of the whole row; of
    rows equal in all columns one stays.  So reruns keep the same row.  Other
    columns, whatever their names, are carried along; an empty table gives an
    empty result.  Only rows that may have to go are shuffled with their texts.
    """
    keyed = _packed(docs).select("doc_id", "text", "row", F.xxhash64("row").alias("k1"), F.xxhash64(F.lit(1), "row").alias("k2"))
    found = written(ngram_join.near_duplicates(keyed, keep=("k1", "k2")).where("n_ngrams > 0").select("k1", "k2", "node", "is_first"), "pipeline-near")
    first = found.where("is_first").groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("w")).select(F.col("w.k1").alias("k1"), F.col("w.k2").alias("k2"), F.lit(True).alias("first"))
    counted = found.groupBy("k1", "k2").agg(F.count("*").alias("n")).join(first.hint("merge"), ["k1", "k2"], "left")
    #: Rows that go, and rows that stay but once.
    contested = written(counted.where("first is null or n > 1").select("k1", "k2", F.col("first").isNotNull().alias("first")), "pipeline-contested", found)
    flagged = maybe_in(keyed, contested, "k1", "k2")
    sure = flagged.where("not _maybe").select("row")
    checked = flagged.where("_maybe").join(contested.hint("merge"), ["k1", "k2"], "left")
    kept = checked.where("first is null").select("row").unionByName(checked.where("first").dropDuplicates(["k1", "k2"]).select("row"))
    return _unpacked(sure.unionByName(kept), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes go from all texts; every document keeps its row.

    Every occurrence goes, the first too.  Null texts become empty, short texts
    stay whole; n_chars, if there is such a column, is counted anew; repeated
    rows and null ids stay; other columns, whatever their names, are carried
    along; an empty table gives an empty result.
    """
    cut = suffix_dedup.remove_repeats(_packed(docs, "text", "n_chars"), keep=("row",), with_text=True)
    return _unpacked(cut, docs, text=F.col("text"), n_chars=F.length("text"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated as the mix of the sources says.

    Each row has a number of copies of its own, 0 to 3, also among repeated
    rows; texts without words (null, empty, blank) stay once; a null source is
    one of its own; other columns, whatever their names, are carried along; an
    empty table gives an empty result.  Texts aren't shuffled, but for those of
    one bin of each source.
    """
    mixed = mixing.mix_sources(_packed(docs), keep=("row",)).where("copies > 0")
    return _unpacked(mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")), docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text: doc_id, n_tokens, two digests and the ids.

    Null texts are empty and have no token; repeated rows and null ids stay;
    other columns are ignored; an empty table gives an empty result.
    """
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality_classifier", quality_classifier), ("ngram_join", near_duplicates), ("suffix_dedup", repeated_passages), ("mixing", source_mix), ("byte_bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written as Parquet to the shared folder and read again.

    What a stage wrote on its way goes when its result is written.
    """
    docs = read_table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs
