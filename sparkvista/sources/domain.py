"""Businesses and reviews as views of the provided star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A table of Parquet files with _place, (file, row): the order in which the rows were written."""
    rows = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return rows.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("_place"))


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, with nations as cities and regions as states."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.col("s_suppkey").alias("business_id"), F.col("s_name").alias("name"), F.col("n_name").alias("city"), F.col("r_name").alias("state"), F.col("s_acctbal").alias("stars"), F.lit(0).alias("review_count"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, whose quantity, discount and tax stand for stars and two sentiment scores."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("review_id"), F.col("l_suppkey").alias("business_id"), F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_quantity").alias("stars"), F.col("l_discount").alias("sentiment_score_prob_diff"), F.col("l_tax").alias("sentiment_score_expected"),
    )


def order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reviews with a unique id, by customers as businesses."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("review_id"), F.col("o_custkey").alias("business_id"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("stars"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as businesses with searchable texts."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("business_id"), F.col("p_name").alias("name"), F.col("p_type").alias("city"), F.col("p_brand").alias("state"),
        F.concat_ws(", ", "p_name", "p_type", "p_brand").alias("categories"), F.col("p_retailprice").alias("stars"), F.col("p_size").alias("review_count"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as places: the first two elements are longitude and latitude."""
    at = lambda k, scale: F.col("embedding")[k].cast("double") * float(scale)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("business_id"), at(0, 180).alias("longitude"), at(1, 85).alias("latitude"), F.col("label").alias("stars"), F.col("vec_id").alias("review_count"))
