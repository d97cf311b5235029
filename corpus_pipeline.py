"""A corpus pipeline of five stages; each reads the whole table that the stage before it wrote.

For all stages: null texts are empty texts, and null ids and sources are values like others; an empty table stays
empty; very long texts are read whole; columns of docs come back, whatever their names, but for those that a
stage's docstring names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkvista.llm import decontamination, mixing, ngram_join, sharding, toxicity
from sparkvista.llm.common import fresh_dir, materialize, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go. Repeated rows are judged alike; labels with a null id or toxic value don't teach."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays: that of the least id, ties by the MD5 of the text, null ids last.

    Rows equal in every column are copies, of which one stays; rows without words have no copies, and all stay.
    """
    return ngram_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. Equal texts and repeated rows are judged alike; null items match nothing."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: every document as often as the mix takes it.

    Ties: rows that agree in id and text are copies, and as many as fit the budget are taken, any of them. Columns
    named size, source_size, target, taken or repeats are left out.
    """
    return mixing.repeat_rows(mixing.mix_sources(docs, table(spark, sf_dir, "labels")))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix goes into shards; its rows, repeated ones too, come back with their shard. Ties and equal rows may be in any shard."""
    return sharding.shard_arrivals(docs, fresh_dir(spark, "corpus")).read_with_shards()


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", ngram_join_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing_sources", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL can't express the classifier, MinHash and sharding; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
