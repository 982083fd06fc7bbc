"""The operators of this subpackage as queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ampliq.llm import bpe, fim, langid, licenses, media, mixing, ngram_join, phrases, quality_model, quality_rules, sharding, suffix_dedup, urls
from ampliq.llm.common import read_table


def _tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"), *_tokenizer())


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_ngrams")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_table(read_table(spark, sf_dir, "documents")).drop("clips")


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed clips of the stored form of every document, found by parsing and decoding the files."""
    return media.clip_rows(media.media_table(read_table(spark, sf_dir, "documents"), with_media=True))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(read_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(read_table(spark, sf_dir, "pages"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def shard_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that move, and where, when the weights of the shards change and one joins."""
    return sharding.moves(read_table(spark, sf_dir, "documents"), "doc_id", sharding.BEFORE, sharding.AFTER)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_byte_bpe, op2_ngram_join, op3_quality_rules, op4_suffix_dedup, op5_license_scan, op6_quality_classifier, op7_mixing, op8_media, media_clips, op9_language_id, op10_url_filter, op11_sharding, shard_moves, op12_phrases, op13_fill_in_middle)}
ORACLE_SQL: dict[str, str] = {"op3_quality_rules": quality_rules.ORACLE, "op5_license_scan": licenses.ORACLE, "op11_sharding": sharding.ORACLE, "shard_moves": sharding.MOVES_ORACLE, "op12_phrases": phrases.ORACLE, "op13_fill_in_middle": fim.ORACLE}
