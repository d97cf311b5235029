"""Validating ingest: each record is inserted, skipped (loaded before), an orphan or an error.

A null field counts as absent. Records without a required field are errors and do not stop the load.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import schema


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in defaults.items() if c in df.columns})


def parse_date(raw: Column) -> Column:
    """The date before the first blank; null where it is none."""
    return F.to_date(F.try_to_timestamp(F.split(raw, " ")[0], F.lit("y-M-d")))


def outcomes(raw: DataFrame, key: str, loaded: DataFrame | None = None, parents: DataFrame | None = None, parent_key: str = "business_id", valid: Column | None = None) -> DataFrame:
    """raw with `outcome`: skipped before orphaned before error before inserted.

    raw has _ordinal, which no two records of a key share. Of records with one key the first that can be inserted
    is; later ones are skipped. The first is a minimum by key, combined before its shuffle, and comes back to its
    record by key and _ordinal, so that neither a key that very many records share nor null keys are a hot spot.
    loaded and parents hold keys that exist, each once; Spark splits their joins where a key is hot.
    """
    rows = raw
    if loaded is not None:
        rows = rows.join(loaded.select(key, F.lit(True).alias("_loaded")), key, "left")
    if parents is not None:
        rows = rows.join(parents.select(parent_key, F.lit(True).alias("_parent")), parent_key, "left")
    fine = F.col(key).isNotNull() & F.coalesce(valid if valid is not None else F.lit(True), F.lit(False))
    first = F.when(F.col("_loaded").isNotNull() if loaded is not None else F.lit(False), "skipped")
    if parents is not None:
        first = first.when(F.col("_parent").isNull(), "orphaned")
    rows = rows.withColumn("outcome", first.when(~fine, "error").otherwise("inserted"))
    firsts = rows.filter("outcome = 'inserted'").groupBy(key).agg(F.min("_ordinal").alias("_ordinal")).withColumn("_won", F.lit(True))
    rows = rows.join(firsts, [key, "_ordinal"], "left")
    late = (F.col("outcome") == "inserted") & F.col("_won").isNull()
    return rows.withColumn("outcome", F.when(late, "skipped").otherwise(F.col("outcome"))).select(*raw.columns, "outcome")


def report(rows: DataFrame) -> DataFrame:
    """How many records have each outcome."""
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("records"))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter("outcome = 'inserted'").drop("outcome", "_ordinal")


def ingest_businesses(raw: DataFrame, loaded: DataFrame | None = None) -> DataFrame:
    present = F.lit(True)
    for c in schema.REQUIRED:
        present = present & F.col(c).isNotNull()
    rows = outcomes(raw, "business_id", loaded, valid=present)
    return with_defaults(rows, schema.BUSINESS_DEFAULTS).withColumns({c: F.coalesce(c, F.create_map().cast("map<string,string>")) for c in ("attributes", "hours") if c in raw.columns})


def ingest_photos(raw: DataFrame, businesses: DataFrame, loaded: DataFrame | None = None) -> DataFrame:
    return with_defaults(outcomes(raw, "photo_id", loaded, businesses), schema.PHOTO_DEFAULTS)


def ingest_reviews(raw: DataFrame, businesses: DataFrame, loaded: DataFrame | None = None) -> DataFrame:
    rows = raw.withColumn("date", parse_date(F.col("date")))
    return with_defaults(outcomes(rows, "review_id", loaded, businesses, valid=F.col("date").isNotNull()), schema.REVIEW_DEFAULTS)


def table_counts(**tables: DataFrame) -> DataFrame:
    """(table_name, row_count) of each."""
    counts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def out_of_range(df: DataFrame) -> DataFrame:
    """Rows with a value outside the ranges of schema.RANGES."""
    bad = F.lit(False)
    for c, (low, high) in schema.RANGES.items():
        if c in df.columns:
            bad = bad | F.coalesce(F.col(c) < low, F.lit(False))
            bad = bad if high is None else bad | F.coalesce(F.col(c) > high, F.lit(False))
    return df.filter(bad)
