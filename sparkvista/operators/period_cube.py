"""A stored cube of daily states, from which timelines and comparisons of any period are rolled up.

Reviews are read once, when they come. What is stored for a day adds up: sums and counts by business and by area,
and exact sets of businesses by area, as bitmaps over numbered businesses, a row for each bucket of 32,768
numbers. Weeks, months and years add sums and join bitmaps; a later batch of reviews is another part of the
cube, which needs no new scan of the old ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import numbered
from .timeline import METRICS, Scope, check, in_range, period_start

MEASURES = tuple(c for columns in METRICS.values() for c in columns.values())


def _states() -> list[Column]:
    return [*[f(c).alias(f"{n}_{c}") for c in MEASURES for f, n in ((F.sum, "sum"), (F.count, "count"))], F.count("review_id").alias("reviews")]


def _averages(metric: str) -> list[Column]:
    """As timeline() rounds them: the sum first, so that the order of addition does not show."""
    return [F.round(F.coalesce(F.round(F.sum(f"sum_{c}"), 6) / F.nullif(F.sum(f"count_{c}"), F.lit(0)), F.lit(0.0)), 6).alias(name) for name, c in METRICS[metric].items()]


@dataclass
class PeriodCube:
    """Folders `businesses` (business_id, state, city, number), `days` by business, `areas` and `sets` by area, each with a subfolder for a part."""

    spark: SparkSession
    path: str

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @classmethod
    def create(cls, businesses: DataFrame, path: str) -> PeriodCube:
        """Numbers the businesses; each id once, null ids left out."""
        known = businesses.filter("business_id is not null").select("business_id", "state", "city")
        numbered(known, ["state", "city", "business_id"], "number").write.parquet(f"{path}/businesses")
        return cls(businesses.sparkSession, path)

    def add_businesses(self, businesses: DataFrame) -> None:
        """New businesses get the numbers after the greatest; those that are there keep theirs."""
        old = self._read("businesses")
        most = old.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
        fresh = businesses.filter("business_id is not null").select("business_id", "state", "city").join(old, "business_id", "left_anti")
        numbered(fresh, ["state", "city", "business_id"], "number").withColumn("number", F.col("number") + most).write.mode("append").parquet(f"{self.path}/businesses")

    def append(self, reviews: DataFrame, part: str) -> None:
        """Adds the daily states of reviews that aren't in the cube yet; a part that exists is an error.

        Null measures are left out of averages; a null date is a day of its own; reviews of unknown businesses count
        for the business, not for areas. Sums are combined before they are shuffled, so a hot business is no hot task.
        """
        rows = reviews.select("review_id", "business_id", F.col("date").alias("day"), *MEASURES)
        days = rows.groupBy("business_id", "day").agg(*_states())
        days.repartitionByRange("business_id", "day").sortWithinPartitions("business_id", "day").write.parquet(f"{self.path}/days/part={part}")
        days = self.spark.read.parquet(f"{self.path}/days/part={part}")
        known = days.join(self._read("businesses"), "business_id")
        sums = [c for c in days.columns if c not in ("business_id", "day")]
        areas = known.groupBy("state", "city", "day").agg(*[F.sum(c).alias(c) for c in sums])
        areas.sortWithinPartitions("state", "city", "day").write.parquet(f"{self.path}/areas/part={part}")
        sets = known.groupBy("state", "city", "day", F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
        sets.sortWithinPartitions("state", "city", "day").write.parquet(f"{self.path}/sets/part={part}")

    def _areas(self, rows: DataFrame, sets: DataFrame, metric: str, period: str) -> DataFrame:
        """Areas' states and sets rolled up to periods."""
        start = period_start(F.col("day"), period).alias("period_start")
        sums = rows.groupBy(start).agg(*_averages(metric), F.sum("reviews").alias("review_count"))
        counts = sets.groupBy(start, "bucket").agg(F.bitmap_or_agg("bits").alias("bits")).groupBy("period_start").agg(F.sum(F.bitmap_count("bits")).alias("business_count"))
        counts = counts.withColumnRenamed("period_start", "p")
        return sums.join(counts, sums["period_start"].eqNullSafe(counts["p"])).drop("p")

    def timeline(self, scope: Scope, metric: str = "rating", period: str = "month", start: str | None = None, end: str | None = None) -> DataFrame:
        """What timeline() gives over the reviews of all parts."""
        check(period, metric)
        within = lambda df: in_range(df.withColumn("date", F.col("day")), start, end).drop("date")
        if scope.kind == "business":
            rows = within(self._read("days")).filter(F.col("business_id") == scope.business_id)
            return rows.groupBy(period_start(F.col("day"), period).alias("period_start")).agg(*_averages(metric), F.sum("reviews").alias("review_count")).orderBy("period_start")
        here = F.col("state") == scope.state
        here = here & (F.col("city") == scope.city) if scope.kind == "city" else here
        return self._areas(within(self._read("areas")).filter(here), within(self._read("sets")).filter(here), metric, period).orderBy("period_start")

    def compare(self, business_id: object, kind: str, metric: str = "rating", period: str = "month", start: str | None = None, end: str | None = None) -> DataFrame:
        """What compare() gives over the reviews of all parts."""
        where = ["state", "city"] if kind == "city" else ["state"]
        mine = self._read("businesses").filter(F.col("business_id") == business_id)
        within = lambda df: in_range(df.withColumn("date", F.col("day")), start, end).drop("date").join(mine.select(*where).distinct(), where, "left_semi")
        own = self.timeline(Scope("business", business_id), metric, period, start, end)
        known = own.join(mine.select(F.lit(1)).limit(1), how="left_semi")
        area = self._areas(within(self._read("areas")), within(self._read("sets")), metric, period)
        both = known.withColumns({"business_count": F.lit(1).cast("long"), "data_type": F.lit("business")}).unionByName(area.withColumn("data_type", F.lit(kind)))
        return both.orderBy("period_start", "data_type")
