"""What a map of businesses shows: filters, clusters by zoom, centroids, categories."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS, EXTENT, MAX_ZOOM = 75, 512, 20


def map_filter(df: DataFrame, city: str | None = None, category: str | None = None, rating: float | None = None, is_open: int | None = None) -> DataFrame:
    """Each filter holds only if it is given; a category matches anywhere in the list, in any case."""
    for c, value in (("city", city), ("stars", rating), ("is_open", is_open)):
        if value is not None:
            df = df.filter(F.col(c) == value)
    return df if category is None else df.filter(F.lower("categories").contains(category.lower()))


def map_total(df: DataFrame, **filters: object) -> DataFrame:
    """One row: how many businesses the filters of map_filter() leave."""
    return map_filter(df, **filters).agg(F.count(F.lit(1)).alias("total"))


def located(df: DataFrame) -> DataFrame:
    """Rows with both coordinates: not null, not NaN, not 0."""
    for c in ("latitude", "longitude"):
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) != 0))
    return df


def mercator() -> tuple[Column, Column]:
    """Web-Mercator coordinates in [0, 1]."""
    s = F.sin(F.radians("latitude"))
    y = F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * math.pi)
    return (F.col("longitude") + 180) / 360, F.greatest(F.lit(0.0), F.least(F.lit(1.0), y))


def clusters(df: DataFrame, zoom: float = 4, bbox: tuple[float, float, float, float] = (-180.0, -85.0, 180.0, 85.0)) -> DataFrame:
    """Cells of a grid at a zoom: point_count, mean place, and the zoom at which a cell of several points splits.

    A grid in place of greedy clustering, whose result depends on the order of points: counts sum to the
    points, and every run agrees. Extremes of x and y tell at which zoom the members part, so one aggregation
    is enough. bbox (west, south, east, north) selects by the mean place. A zoom of MAX_ZOOM is the last one.
    """
    z = min(MAX_ZOOM, max(0, math.floor(zoom)))
    cell = lambda c, k: F.floor(c * (EXTENT / RADIUS) * F.pow(F.lit(2.0), F.lit(k) if isinstance(k, int) else k))
    x, y = mercator()
    west, south, east, north = bbox
    rows = located(df).withColumn("x", x).withColumn("y", y)
    # the mean of a cell lies within the cell, so that points further from the box than a cell's width can't count
    side = RADIUS / EXTENT / 2.0**z
    edge = lambda deg: 0.5 - math.asinh(math.tan(math.radians(max(-85.06, min(85.06, deg))))) / (2 * math.pi)
    if south > -85 or north < 85:
        rows = rows.filter(F.col("y").between(edge(north) - 1.01 * side, edge(south) + 1.01 * side))
    rows = rows.filter(F.col("longitude").between(west - 1.01 * 360 * side, east + 1.01 * 360 * side))
    ends = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]
    rows = rows.groupBy(cell(F.col("x"), z).alias("cell_x"), cell(F.col("y"), z).alias("cell_y")).agg(F.count(F.lit(1)).alias("point_count"), F.round(F.avg("longitude"), 6).alias("longitude"), F.round(F.avg("latitude"), 6).alias("latitude"), *ends)
    rows = rows.filter(F.col("longitude").between(west, east) & F.col("latitude").between(south, north))
    part = lambda k: (cell(F.col("x0"), k) != cell(F.col("x1"), k)) | (cell(F.col("y0"), k) != cell(F.col("y1"), k))
    splits = F.filter(F.sequence(F.lit(z), F.lit(MAX_ZOOM)), part)
    expansion = F.when(F.col("point_count") > 1, F.coalesce(F.try_element_at(splits, F.lit(1)), F.lit(MAX_ZOOM)))
    return rows.select("cell_x", "cell_y", "point_count", (F.col("point_count") > 1).alias("is_cluster"), "longitude", "latitude", expansion.alias("expansion_zoom"))


def marker_size(count: Column, total: int) -> Column:
    return 30 + count / float(max(1, total)) * 50


def city_centroid(df: DataFrame, by: str = "city") -> DataFrame:
    """Mean coordinates, each over its own values that are numbers."""
    mean = lambda c: F.round(F.avg(F.when(~F.isnan(c), F.col(c))), 6).alias(c)
    return df.groupBy(by).agg(mean("latitude"), mean("longitude"))


def category_list(df: DataFrame, limit: int | None = 200) -> DataFrame:
    """The distinct categories in alphabetical order."""
    rows = df.select(F.explode(F.transform(F.split("categories", ","), lambda c: F.trim(c))).alias("category")).filter("category <> ''").distinct().orderBy("category")
    return rows if limit is None else rows.limit(limit)


def first_seen(df: DataFrame, column: str = "categories", separator: str | None = ",", limit: int | None = 200, place: str = "_place") -> DataFrame:
    """(value, place, nth) of the distinct values in the order in which a reader of the rows meets them, cut by that order.

    place orders the rows (sources.domain.placed() has it from files and their rows); separator splits a field, whose
    parts are trimmed, null: the field is one value. Empty values and nulls are left out. A least place for each value
    is combined before the shuffle, so the number of partitions and hot values don't matter.
    """
    parts = F.split(column, separator) if separator is not None else F.array(F.col(column))
    rows = df.select(F.col(place).alias("place"), F.posexplode(parts).alias("nth", "value")).withColumn("value", F.trim("value")).filter("value <> ''")
    rows = rows.groupBy("value").agg(F.min(F.struct("place", "nth")).alias("first")).orderBy("first")
    return (rows if limit is None else rows.limit(limit)).select("value", "first.place", "first.nth")


def popup(df: DataFrame) -> DataFrame:
    """What a marker's popup shows: the first three categories, and the status."""
    status = F.when(F.col("is_open") != 0, "Open").otherwise("Closed") if "is_open" in df.columns else F.lit("Open")
    return df.select("business_id", F.array_join(F.slice(F.split("categories", ","), 1, 3), ", ").alias("categories"), status.alias("status"))
