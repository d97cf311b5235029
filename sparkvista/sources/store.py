"""Tables that jobs leave for each other, in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests, a local master gets a local one, and any other an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "sparkvista-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """df as a Parquet table, which cuts the lineage and survives lost executors."""
    path = path or fresh_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with `name`, each row's number from 0 in the order of columns, nulls first; equal rows in any order.

    Rows are dealt by ranges and sorted; a task's first number is the count of the tasks before it, one row for each
    task, so that no task sorts the whole.
    """
    keys = [F.asc_nulls_first(c) for c in order]
    rows = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("__task", F.shiftright("__at", 33))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tasks = rows.groupBy("__task").agg(F.count(F.lit(1)).alias("__n")).select("__task", before.alias("__before"))
    return rows.join(F.broadcast(tasks), "__task").withColumn(name, F.col("__at").bitwiseAND((1 << 33) - 1) + F.col("__before")).drop("__task", "__at", "__before")
