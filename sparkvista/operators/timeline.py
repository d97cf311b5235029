"""Ratings and sentiment over time, for one business, a city or a state, and comparisons between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIODS = ("day", "week", "month", "year")
METRICS = {"rating": {"avg_rating": "stars"}, "sentiment": {"avg_sentiment_score": "sentiment_score_prob_diff", "avg_sentiment_expected": "sentiment_score_expected"}}


@dataclass(frozen=True)
class Scope:
    """What a timeline covers: kind is business, city or state; a city is named within its state."""

    kind: str
    business_id: object = None
    city: str | None = None
    state: str | None = None

    def of(self, businesses: DataFrame) -> DataFrame:
        """The ids of the businesses in a city or state."""
        rows = businesses.filter(F.col("state") == self.state)
        return (rows.filter(F.col("city") == self.city) if self.kind == "city" else rows).select("business_id")


def check(period: str, metric: str) -> None:
    if period not in PERIODS:
        raise ValueError(f"period must be one of {', '.join(PERIODS)}")
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")


def period_start(date: Column, period: str) -> Column:
    """The first day of the date's period; weeks begin on Monday."""
    return F.date_trunc(period, date.cast("date")).cast("date")


def in_range(reviews: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Both bounds are inclusive and optional; start after end leaves nothing."""
    if start is not None:
        reviews = reviews.filter(F.col("date") >= F.lit(start).cast("date"))
    return reviews if end is None else reviews.filter(F.col("date") <= F.lit(end).cast("date"))


def _averages(metric: str, where: Column | None = None) -> list[Column]:
    pick = (lambda c: F.col(c)) if where is None else (lambda c: F.when(where, F.col(c)))
    # the sum is rounded first, so that the order in which partitions are added does not show
    return [F.round(F.coalesce(F.round(F.sum(pick(c)), 6) / F.nullif(F.count(pick(c)), F.lit(0)), F.lit(0.0)), 6).alias(name) for name, c in METRICS[metric].items()]


def timeline(reviews: DataFrame, scope: Scope, metric: str = "rating", period: str = "month", start: str | None = None, end: str | None = None, businesses: DataFrame | None = None) -> DataFrame:
    """period_start, the averages of the metric, review_count and, for a city or state, business_count.

    An average without values is 0; periods without reviews are absent. The filtered side of the join is a set
    of ids: Spark broadcasts it if its statistics say it is small, and shuffles both sides otherwise.
    """
    check(period, metric)
    rows = in_range(reviews, start, end)
    more = []
    if scope.kind == "business":
        rows = rows.filter(F.col("business_id") == scope.business_id)
    else:
        rows = rows.join(scope.of(businesses), "business_id", "left_semi")
        more = [F.count_distinct("business_id").alias("business_count")]
    grouped = rows.groupBy(period_start(F.col("date"), period).alias("period_start"))
    return grouped.agg(*_averages(metric), F.count("review_id").alias("review_count"), *more).orderBy("period_start")


def compare(reviews: DataFrame, businesses: DataFrame, business_id: object, kind: str, metric: str = "rating", period: str = "month", start: str | None = None, end: str | None = None) -> DataFrame:
    """The timelines of a business and of its own city or state, tagged by data_type.

    The business lies in its city, so one scan and one aggregation give both sides; a business side without
    reviews in a period is dropped. business_count is 1 on the business side. An unknown id gives no rows.
    """
    check(period, metric)
    mine = businesses.filter(F.col("business_id") == business_id)
    where = ["state", "city"] if kind == "city" else ["state"]
    peers = businesses.join(mine.select(*where).distinct(), where, "left_semi").select("business_id")
    own = F.col("business_id") == business_id
    rows = in_range(reviews, start, end).join(peers, "business_id", "left_semi")
    names = [*METRICS[metric], "review_count", "business_count"]
    sides = rows.groupBy(period_start(F.col("date"), period).alias("period_start")).agg(
        F.struct(*_averages(metric, own), F.count(F.when(own, F.col("review_id"))).alias("review_count"), F.lit(1).cast("long").alias("business_count"), F.lit("business").alias("data_type")).alias("a"),
        F.struct(*_averages(metric), F.count("review_id").alias("review_count"), F.count_distinct("business_id").alias("business_count"), F.lit(kind).alias("data_type")).alias("b"),
    )
    both = sides.select("period_start", F.explode(F.array("a", "b")).alias("x"))
    return both.select("period_start", *[F.col(f"x.{n}").alias(n) for n in names], F.col("x.data_type").alias("data_type")).filter("review_count > 0").orderBy("period_start", "data_type")
