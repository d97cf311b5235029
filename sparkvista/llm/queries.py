"""The queries of this package, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat, decontamination, lm_scoring, merkle, mixing, ngram_join, prefix_trie, quality, sharding, suffix_dedup, token_store, toxicity
from .common import fresh_dir, table
from .sql import ORACLE_SQL as ORACLE_SQL

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_figures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "size", "source_size", "target", "taken")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).selectExpr("cast(-1 as bigint) conv_id", "id turn", "if(id = 0, 'user', 'assistant') role", f"'{said}' text")
    return chat.chat_digests(chat.format_chats(rows.unionByName(more)))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_digests(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_mixing, op3_chat_formatting, op6_token_output, op8_quality_rules, op10_toxicity)}


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_links(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


QUERIES |= {f.__name__: f for f in (op9_ngram_join,)}


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op2_suffix_dedup,)}


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text")


QUERIES |= {f.__name__: f for f in (op5_decontamination,)}


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = sharding.shard_arrivals(table(spark, sf_dir, "documents"), fresh_dir(spark, "shards"))
    return store.read_with_shards().selectExpr("doc_id", "n_chars", "xxhash64(text) as text_hash", "shard_no", "shard_rows", "version")


QUERIES |= {f.__name__: f for f in (op4_sharding,)}


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op7_lm_scoring,)}


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_digests(table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op11_byte_bpe,)}


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_digests(table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op12_merkle_manifest,)}


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES |= {f.__name__: f for f in (op13_prefix_trie,)}
