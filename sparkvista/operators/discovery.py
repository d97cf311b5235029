"""Lookup, listing, bounding box, locations and ranked search of businesses.

Every order that a page is cut from ends with the key, so that pages are stable.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.trigram import like_pattern, similarity_to, trigrams

#: The least similarity of a match; marks of exact names, of similarity, and of fields that contain the query.
SIMILAR = 0.3
EXACT, WEIGHT, PARTIAL = (("name", 100), ("city", 90), ("state", 85)), (("name", 50), ("city", 40), ("categories", 30)), (("name", 20), ("city", 15), ("categories", 10))
FIELDS, TEXTS = ("name", "city", "categories"), ("name", "city", "state", "categories")
_BEST = [F.desc_nulls_first, "stars"], [F.desc_nulls_first, "review_count"]


def by_id(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.filter(F.col(key) == value).limit(1)


def _order() -> list[Column]:
    return [*(f(c) for f, c in _BEST), F.asc("business_id")]


def list_businesses(df: DataFrame, state: str | None = None, city: str | None = None, skip: int = 0, limit: int = 100) -> DataFrame:
    if state is not None:
        df = df.filter(F.col("state") == state)
    if city is not None:
        df = df.filter(F.col("city") == city)
    return df.orderBy(*_order()).offset(skip).limit(limit)


def in_viewport(df: DataFrame, south: float, west: float, north: float, east: float, limit: int = 1_000) -> DataFrame:
    """Businesses inside a box, its edges included."""
    return df.filter(F.col("latitude").between(south, north) & F.col("longitude").between(west, east)).orderBy(*_order()).limit(limit)


def reviews_of(reviews: DataFrame, business_id: object, skip: int = 0, limit: int = 100) -> DataFrame:
    return reviews.filter(F.col("business_id") == business_id).orderBy(F.desc_nulls_first("date"), "review_id").offset(skip).limit(limit)


def states(df: DataFrame) -> DataFrame:
    return df.select("state").distinct().orderBy("state")


def cities_of(df: DataFrame, state: str) -> DataFrame:
    return df.filter(F.col("state") == state).select("city").distinct().orderBy("city")


def first_of(cases: list[tuple[Column, int]]) -> Column:
    """The mark of the first case that holds, else 0."""
    return F.coalesce(*[F.when(test, mark) for test, mark in cases], F.lit(0))


def with_trigrams(df: DataFrame) -> DataFrame:
    """Adds the trigrams that search() compares; they don't depend on the query, so a stored table can hold them.

    They are the columns of a generated row, which Spark works out once, wherever filters and orders use them.
    """
    return df.select("*", F.inline(F.array(F.struct(*[trigrams(F.col(c)).alias(f"{c}_trigrams") for c in FIELDS]))))


def search(df: DataFrame, query: str, skip: int = 0, limit: int = 20) -> DataFrame:
    """Businesses that any term of the query matches, in a field or by similar trigrams, the most relevant first.

    A blank query matches all. Terms decide what matches, the whole query decides the order: exact names
    first, then weighted similarities, and a bonus for fields that contain the query. % and _ are wildcards.
    """
    if "name_trigrams" not in df.columns:
        df = with_trigrams(df)
    q = query.strip().lower()
    like = lambda c, t: F.coalesce(F.col(c).ilike(like_pattern(t)), F.lit(False))
    tests = [like(c, t) for t in q.split() for c in TEXTS]
    tests += [similarity_to(F.col(f"{c}_trigrams"), t).cast("double") > SIMILAR for t in q.split() for c in FIELDS]
    matches = reduce(or_, tests) if tests else F.lit(True)
    exact = first_of([(F.lower(c) == q, mark) for c, mark in EXACT])
    similar = sum((similarity_to(F.col(f"{c}_trigrams"), q).cast("double") * w for c, w in WEIGHT), F.lit(0.0))
    partial = first_of([(like(c, q), mark) for c, mark in PARTIAL])
    rows = df.filter(matches).withColumn("relevance", F.round(exact + similar + partial, 6))
    return rows.orderBy(F.desc("relevance"), *_order()).offset(skip).limit(limit).drop("name_trigrams", "city_trigrams", "categories_trigrams")
