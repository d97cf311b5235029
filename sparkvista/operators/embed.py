"""Batch text embedding: one row holds a vector and its metadata, so the two can't come apart."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import HashingTF, NGram, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.npy import files, read_npy, write_npy
from ..sources.store import numbered, stored

METADATA = ("business_id", "stars", "sentiment", "sentiment_label", "date", "user_id")
#: Makes a model on a worker: it takes texts and gives one vector for each.
Encoder = Callable[[], Callable[[list[str]], list]]


def metadata(df: DataFrame, key: str = "review_id", optional: tuple[str, ...] = METADATA) -> DataFrame:
    """The key, and of the optional columns those that are there."""
    return df.select(key, *[c for c in optional if c in df.columns])


def l2_normalize(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays, null stays null. The length is bound once, as the one element of an array."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    divisor = F.array(F.when(norm > 0, norm).otherwise(1.0))
    return F.when(vector.isNotNull(), F.get(F.transform(divisor, lambda n: F.transform(vector, lambda x: (x / n).cast("float"))), F.lit(0)))


def hashed_embedding(df: DataFrame, dim: int = 64) -> DataFrame:
    """df with `embedding`, hashed words and word pairs at length 1, all in the JVM. A null text is empty, its vector zero."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), "\\s+"), lambda w: w != "")
    rows = NGram(n=2, inputCol="_words", outputCol="_pairs").transform(df.withColumn("_words", words))
    rows = rows.withColumn("_tokens", F.concat("_words", "_pairs"))
    rows = Normalizer(inputCol="_counts", outputCol="_unit").transform(HashingTF(numFeatures=dim, inputCol="_tokens", outputCol="_counts").transform(rows))
    return rows.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_words", "_pairs", "_tokens", "_counts", "_unit")


#: Gigabytes of memory, and the texts of a batch from there on.
BATCHES = ((15, 1_024), (12, 768), (0, 512))


def batch_size_for(gigabytes: float) -> int:
    """The texts that a model with so much memory gets at a time."""
    return next(n for least, n in BATCHES if gigabytes >= least)


def memory_here() -> float:
    """Gigabytes of free memory of the machine a worker runs on."""
    return os.sysconf("SC_AVPHYS_PAGES") * os.sysconf("SC_PAGE_SIZE") / 1e9


def encode(df: DataFrame, encoder: Encoder, batch_size: int | None = None, memory: Callable[[], float] = memory_here) -> DataFrame:
    """df with `embedding` from a model that each worker makes once and that gets batch_size texts at a time.

    Without batch_size each worker chooses one by the gigabytes that `memory` finds there, such as a device's.
    """
    wanted = batch_size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, batch_size = encoder(), wanted or batch_size_for(memory())
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            parts = [model(texts[k : k + batch_size]) for k in range(0, len(texts), batch_size)]
            yield batch.assign(embedding=[[float(x) for x in v] for part in parts for v in part])

    rows = df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", embedding array<float>")
    return rows.withColumn("embedding", l2_normalize(F.col("embedding")))


def check_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: how many vectors there are, their least and greatest dimension, and those not of length 1."""
    norm = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return df.agg(F.count(vector).alias("vectors"), F.min(F.size(vector)).cast("long").alias("least_dim"), F.max(F.size(vector)).cast("long").alias("most_dim"), F.sum((F.abs(norm - 1) > 1e-5).cast("long")).alias("not_unit"))


def save_vectors(df: DataFrame, path: str) -> None:
    """Vectors and their metadata, in one table of Parquet files."""
    df.write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str, rows: int | None = None, vector: str = "embedding") -> DataFrame:
    """A saved table. A vector that is missing, of another length than the rest, or a number of rows other than `rows` is a ValueError."""
    df = spark.read.parquet(path)
    found = check_vectors(df, vector).first()
    total = df.count()
    if found["vectors"] != total or found["least_dim"] != found["most_dim"] or rows not in (None, total):
        raise ValueError(f"{path} has {total} rows and {found['vectors']} vectors of {found['least_dim']} to {found['most_dim']} elements")
    return df


def file_positions(spark: SparkSession, path: str) -> DataFrame:
    """The rows of Parquet files with `position`, from 0 in the order of the files' names and of the rows in each.

    Files are counted first, one row for each; a row's number is its own in the file and the rows of the files before.
    """
    df = spark.read.parquet(path)
    rows = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = stored(rows.groupBy("__file").agg(F.count(F.lit(1)).alias("__n")).select("__file", before.alias("__before")), "files")
    return rows.join(counts, "__file").withColumn("position", F.col("__row") + F.col("__before")).drop("__file", "__row", "__before")


def save_aligned(df: DataFrame, path: str, order: list[str], vector: str = "embedding") -> None:
    """Vectors as `.npy` files and all other columns as Parquet files, in the same order.

    Rows are numbered in the order of columns, nulls first, equal rows in any order; a column `position` of df is
    replaced. Metadata is written last, by ranges of positions, so that its files by name are in that order too.
    """
    rows = stored(numbered(df.drop("position"), order, "position"), "aligned")
    write_npy(rows.select("position", F.col(vector).alias("embedding")), f"{path}/vectors")
    rows.drop(vector).repartitionByRange("position").sortWithinPartitions("position").write.mode("overwrite").parquet(f"{path}/metadata")


def load_aligned(spark: SparkSession, vectors: str, metadata: str) -> DataFrame:
    """The metadata of each vector by position: rows of Parquet files beside those of `.npy` files, as both were saved.

    Without a column `position` in the metadata the rows' places in its files count. Other numbers of rows on the two
    sides, or positions other than one for each vector, are a ValueError.
    """
    meta = spark.read.parquet(metadata)
    if "position" not in meta.columns:
        meta = file_positions(spark, metadata)
    rows = sum(f.rows for f in files(vectors))
    found = meta.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("position").alias("places"), F.min("position").alias("low"), F.max("position").alias("high")).first()
    if (found["rows"], found["places"]) != (rows, rows) or rows and (found["low"], found["high"]) != (0, rows - 1):
        raise ValueError(f"{rows} vectors in {vectors}, and {found['rows']} rows at {found['places']} positions in {metadata}")
    return meta.join(read_npy(spark, vectors), "position")
