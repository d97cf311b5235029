"""Timelines and comparisons from the cube, against those from the reviews."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkvista.operators.period_cube import PeriodCube
from sparkvista.operators.timeline import Scope, compare, timeline
from sparkvista.sources import domain

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def cube(spark, tmp_path_factory):
    """Two parts, with a cut in the middle of a month."""
    reviews, businesses = domain.reviews(spark, SF), domain.businesses(spark, SF)
    cube = PeriodCube.create(businesses, str(tmp_path_factory.mktemp("cube") / "c"))
    cube.append(reviews.filter("date < '1997-05-13'"), "a")
    cube.append(reviews.filter("date >= '1997-05-13'"), "b")
    return cube, reviews, businesses


@pytest.mark.parametrize("period", ["day", "week", "month", "year"])
def test_timelines(cube, period):
    cube, reviews, businesses = cube
    some = businesses.first()
    for scope in (Scope("business", some.business_id), Scope("city", city=some.city, state=some.state), Scope("state", state=some.state)):
        for metric, bounds in (("rating", (None, None)), ("sentiment", ("1996-03-15", "1998-09-02"))):
            want = timeline(reviews, scope, metric, period, *bounds, businesses=businesses)
            assert rows_of(cube.timeline(scope, metric, period, *bounds)) == rows_of(want) and want.count()


def test_comparisons(cube):
    cube, reviews, businesses = cube
    some = businesses.first()
    for kind in ("city", "state"):
        want = compare(reviews, businesses, some.business_id, kind, "sentiment", "month")
        assert rows_of(cube.compare(some.business_id, kind, "sentiment", "month")) == rows_of(want) and want.count()
    assert cube.compare(-5, "city").isEmpty()


def test_nulls_new_businesses_and_many_buckets(spark, tmp_path):
    businesses = spark.range(70_000).selectExpr("id business_id", "'S' state", "if(id % 2 = 0, 'even', 'odd') city")
    day = dt.date
    odd = [(1, 5, day(2024, 1, 7), None, 0.5, None), (2, 5, day(2024, 1, 8), 2.0, None, None), (3, 69_999, day(2024, 1, 8), 1.0, 0.0, 0.0), (4, 99_999, day(2024, 1, 8), 4.0, 0.0, 0.0), (5, None, None, 4.0, 0.0, 0.0), (6, 7, None, 4.0, 0.0, 0.0)]
    reviews = spark.createDataFrame(odd, "review_id long, business_id long, date date, stars double, sentiment_score_prob_diff double, sentiment_score_expected double")
    many = spark.range(70_000).selectExpr("id + 10 review_id", "id business_id", "date'2024-02-01' date", "1D stars", "0D sentiment_score_prob_diff", "0D sentiment_score_expected")
    cube = PeriodCube.create(businesses.limit(0), str(tmp_path / "c"))
    cube.add_businesses(businesses.filter("business_id < 40000"))
    cube.add_businesses(businesses)
    cube.append(reviews.unionByName(many), "all")
    every = reviews.unionByName(many)
    for scope in (Scope("business", 5), Scope("state", state="S"), Scope("city", city="odd", state="S"), Scope("state", state="none")):
        assert rows_of(cube.timeline(scope, "sentiment", "week")) == rows_of(timeline(every, scope, "sentiment", "week", businesses=businesses))
    assert cube.timeline(Scope("state", state="S")).filter("business_count = 70000").count() == 1
    with pytest.raises(Exception, match="(?i)exists"):
        cube.append(reviews, "all")
    numbers = cube._read("businesses").agg(F.count_distinct("number"), F.max("number")).first()
    assert tuple(numbers) == (70_000, 69_999)
