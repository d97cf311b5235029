"""Readers of JSON records, and the Parquet sink."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import json_array


def _array_records(elements: DataFrame, schema: T.StructType) -> DataFrame:
    rows = elements.select(F.from_json("text", schema).alias("r"), F.struct("file", "block", "at").alias("_ordinal"))
    return rows.select(*[F.col(f"r.{f.name}") for f in schema.fields], "_ordinal")


def _line_records(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    marked = T.StructType([T.StructField("v", schema), T.StructField("_bad", T.StringType())])
    record = F.from_json(json_array.only_value(F.col("value")), marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = spark.read.text(paths).select("value", place.alias("_ordinal")).filter(F.trim("value") != "").select(record.alias("r"), "_ordinal")
    return rows.filter("r._bad is null").select(*[F.col(f"r.v.{f.name}") for f in schema.fields], "_ordinal")


def read_records(spark: SparkSession, path: str | list[str], schema: T.StructType, layout: str = "auto") -> DataFrame:
    """Records of JSON arrays and of newline-delimited JSON, with `_ordinal`, their place (file, block, at) in the input.

    Each file is taken by itself: one that is a whole JSON array as that array, any other (also a truncated array)
    as lines, of which blank and undecodable ones are left out. Both are read in splits. An element that isn't an
    object is a record of nulls; a bad field of an element is null. No two records have one place. A path that
    does not exist is a FileNotFoundError. layout "lines" or "array" spares the scans that tell files apart;
    "array" fails on a file that is none.
    """
    try:
        if layout == "lines":
            return _line_records(spark, path, schema)
        elements, arrays, others = json_array.array_files(spark, path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    if layout == "array" and others:
        raise ValueError(f"no JSON array: {', '.join(sorted(others)[:3])}")
    found = [_array_records(elements, schema)] if arrays else []
    if others or not found:
        found.append(_line_records(spark, list(map(json_array.path_of, others)) if others else path, schema))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def read_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Newline-delimited JSON in which one bad line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "append") -> None:
    """One atomic job; partition reviews by a year column to prune date ranges."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def string_map(json: Column) -> Column:
    """A JSON object as map<string,string>; null where it is none."""
    return F.from_json(json, "map<string,string>")
