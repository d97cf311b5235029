"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only a local master, as in tests, may leave it unset; a local one is set then."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "sparkvista-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage, and survives the loss of any executor."""
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only_keys(df: DataFrame, keys: DataFrame, on: list[str], most: int = 1_000_000) -> DataFrame:
    """df without rows whose key isn't in `keys`, where there are few enough keys to send them to every executor.

    keys must be a table that is cheap to read twice, such as one from materialize(). They are counted first;
    beyond `most` rows df comes back as it is, for the join that follows to shuffle both sides.
    """
    if keys.limit(most + 1).count() > most:
        return df
    return df.join(F.broadcast(keys.select(*on).distinct()), on, "left_semi")


def small_join(df: DataFrame, small: DataFrame, on: list[str], how: str, most: int = 1_000_000) -> DataFrame:
    """df joined with a materialized table, which is sent to every executor only if it has at most `most` rows."""
    return df.join(small if small.limit(most + 1).count() > most else F.broadcast(small), on, how)


def ranked(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with `place`, each row's number from 0 in its group by the columns of `order`, nulls first, and `total`, the group's rows.

    Rows are dealt by ranges of group, order and their place in the input, so that neither a large group nor many
    equal rows are one task's; each task's rows of a group are counted, and what other tasks hold before them is
    added. The columns of `by` have no nulls. df should be a table, as its keys are sampled first.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*by, *order, "__salt"]]
    rows = df.withColumn("__salt", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = materialize(rows.drop("__salt").withColumn("__at", F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumn("__task", F.shiftright("__at", 33))
    spans = rows.groupBy("__task", *by).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    group = W.partitionBy(*by)
    before = F.coalesce(F.sum("__rows").over(group.orderBy("__task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = materialize(spans.withColumn("__before", before).withColumn("total", F.sum("__rows").over(group)), "spans")
    rows = small_join(rows, spans.drop("__rows"), ["__task", *by], "inner")
    return rows.withColumn("place", F.col("__at") - F.col("__first") + F.col("__before")).drop("__task", "__at", "__first", "__before")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into slices with about limit bytes in a string column, so that numpy's temporaries stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column).cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
        ends, at = ends[1:] - ends[0], 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and the offsets of its rows; null is empty."""
    whole = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]
