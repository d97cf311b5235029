"""Queries against DuckDB, and the rules of each operator on small hand-made frames."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkvista.functions.trigram import like_pattern, similarity, similarity_to, trigrams
from sparkvista.operators import discovery, embed, ingest, mapview, search_index
from sparkvista.operators.timeline import Scope, compare, timeline
from sparkvista.plans.oracle import ORACLE_SQL
from sparkvista.plans.queries import QUERIES, SEARCHES
from sparkvista.plans.service import ReviewService, ServiceError
from sparkvista.sources import domain, readers, schema

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name == "map_cluster_tree":  # tests/test_cluster_tree.py has its sequential version
        assert df.count() > 500
        return
    names = sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
    found = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == names
    want = sorted((tuple(r[found.columns.index(c)] for c in names) for r in found.fetchall()), key=str)
    assert got == want
    assert got or name in ("search_backslash",)


@pytest.fixture
def shop(spark):
    businesses = spark.createDataFrame([("a", "Joe's Pizza", "Philadelphia", "PA", 4.0, 3, 1, "Pizza, Italian ,Food,Bar", 40.0, -75.0), ("b", "Pho", "Philadelphia", "PA", 4.0, 3, 0, "", float("nan"), -75.2), ("c", "Pie", "Erie", "PA", 4.5, 1, 1, None, 0.0, 1.0), ("d", "x", "Reno", "NV", None, 9, 1, "Bar", None, None)], "business_id string, name string, city string, state string, stars double, review_count int, is_open int, categories string, latitude double, longitude double")
    day = dt.date
    reviews = spark.createDataFrame([("1", "a", day(2024, 1, 7), 5.0, 0.5, 1.0), ("2", "a", day(2024, 1, 8), None, None, None), ("3", "b", day(2023, 1, 1), 1.0, 0.1, 0.2), ("4", "c", day(2024, 1, 8), 3.0, 0.0, 0.0)], "review_id string, business_id string, date date, stars double, sentiment_score_prob_diff double, sentiment_score_expected double")
    return businesses, reviews


def test_timeline_edges(shop):
    businesses, reviews = shop
    rows = timeline(reviews, Scope("business", "a"), "rating", "week").collect()
    assert [(str(r.period_start), r.avg_rating, r.review_count) for r in rows] == [("2024-01-01", 5.0, 1), ("2024-01-08", 0.0, 1)]
    assert str(timeline(reviews, Scope("business", "b"), "rating", "week").first().period_start) == "2022-12-26"
    assert timeline(reviews, Scope("business", "a"), start="2024-01-07", end="2024-01-07").first().review_count == 1
    assert timeline(reviews, Scope("business", "a"), start="2024-02-01", end="2024-01-01").isEmpty()
    assert timeline(reviews, Scope("city", city="Nowhere", state="PA"), businesses=businesses).isEmpty()
    rows = compare(reviews, businesses, "a", "state", "sentiment", "year").collect()
    assert [(r.period_start.year, r.data_type, r.review_count, r.business_count) for r in rows] == [(2023, "state", 1, 1), (2024, "business", 2, 1), (2024, "state", 3, 2)]
    for bad in (("decade", "rating"), ("day", "votes")):
        with pytest.raises(ValueError):
            timeline(reviews, Scope("business", "a"), bad[1], bad[0])
        with pytest.raises(ValueError):
            compare(reviews, businesses, "a", "city", bad[1], bad[0])


def test_similarity(spark):
    pairs = [("word", "two words", 4 / 11), ("Philadelphia", "philadelfia", 0.6), ("Joe's Pizza", "pizza", 0.5), ("abc", "", 0.0), (None, "", 0.0), ("Ærø 7", "ærø 7", 1.0)]
    rows = spark.createDataFrame(pairs, "a string, b string, v double").withColumn("s", similarity(trigrams(F.col("a")), trigrams(F.col("b")))).collect()
    assert all(math.isclose(r.s, r.v, rel_tol=1e-6) for r in rows)
    for a, b, v in pairs:
        got = spark.createDataFrame([(a,)], "a string").select(similarity_to(trigrams(F.col("a")), b).alias("s")).first().s
        assert math.isclose(got, v, rel_tol=1e-6)


def test_like_pattern():
    assert [like_pattern(t) for t in ("a", "a%_", "\\b", "a\\%", "\\\\", "x\\")] == ["%a%", "%a%_%", "%b%", "%a\\%%", "%\\\\%", "%x\\%"]


def test_search_and_pages(shop):
    businesses, _ = shop
    ids = lambda df: [r.business_id for r in df.collect()]
    assert ids(discovery.search(businesses, "philadelfia")) == ["b", "a"]  # "Pho" shares trigrams too
    assert ids(discovery.search(businesses, "PIZZA reno"))[0] == "a"
    assert ids(discovery.search(businesses, " ")) == ["d", "c", "a", "b"]
    assert ids(discovery.search(businesses, "zzz")) == []
    whole = ids(discovery.list_businesses(businesses))
    assert whole == ["d", "c", "a", "b"]
    assert sum((ids(discovery.list_businesses(businesses, skip=k, limit=1)) for k in range(5)), []) == whole
    assert ids(discovery.in_viewport(businesses, 40.0, -75.0, 41.0, -74.0)) == ["a"]


def test_search_by_index_is_search(spark, shop, tmp_path):
    """All searches, wildcards included, give what a scan gives, and verify fewer rows."""
    parts = domain.catalogue(spark, SF)
    index, total, fewer = search_index.SearchIndex.write(parts, str(tmp_path / "i")), parts.count(), 0
    for query in [*SEARCHES.values(), "red", "promo zzz", "br_nd", "%dget%", "\\%dget", "a", "PROMO brand#2"]:
        want = [r.business_id for r in discovery.search(parts, query, limit=400).collect()]
        assert [r.business_id for r in index.search(query, limit=400).collect()] == want, query
        keys = index.candidates(query)
        fewer += keys is not None and keys.count() < total
    assert fewer >= 6
    small = search_index.SearchIndex.write(shop[0], str(tmp_path / "s"))
    for query in ("philadelfia", "PIZZA reno", " ", "zzz", "joe's"):
        assert [r.business_id for r in small.search(query).collect()] == [r.business_id for r in discovery.search(shop[0], query).collect()]


def test_files_of_postings_follow_the_table(spark, tmp_path, monkeypatch):
    """Their number grows with the postings, so that none grows; equal postings of a key that repeats are one."""
    monkeypatch.setattr(search_index, "POSTINGS", 2_000, raising=False)
    parts = domain.catalogue(spark, SF)
    twice = parts.union(parts.withColumn("business_id", F.col("business_id") + 1_000_000)).union(parts.limit(20))
    postings = search_index.SearchIndex.write(twice, str(tmp_path / "p"), files=2).postings
    rows = postings.groupBy(F.input_file_name()).count().agg(F.max("count"), F.sum("count")).first()
    assert rows[0] < 5_000 < rows[1] / 2 and postings.distinct().count() == rows[1]


def test_needed_trigrams():
    need = search_index.needed_trigrams
    assert need("Widget") == ["dge", "get", "idg", "wid"] and need("wi%dget") == ["dge", "get"] and need("a_b") == need("\\") == [] and need("joe's") == ["joe"] and need("ab\\%cde") == ["cde"]


def test_trigrams_are_worked_out_once(spark):
    plan = discovery.search(domain.catalogue(spark, SF), "red widget")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^\\p{L}\\p{N}]+") <= 3


def test_long_vectors(spark):
    rows = spark.range(3).select(F.transform(F.sequence(F.lit(1), F.lit(1_000)), lambda x: (x * (F.col("id") - 1)).cast("float")).alias("v"))
    lengths = [round(sum(x * x for x in r.v), 4) for r in rows.select(embed.l2_normalize(F.col("v")).alias("v")).collect()]
    assert lengths == [1, 0, 1] and spark.sql("SELECT CAST(NULL AS array<float>) v").select(embed.l2_normalize(F.col("v")).alias("v")).first().v is None


def test_map(shop):
    businesses, _ = shop
    assert [r.point_count for r in mapview.clusters(businesses).collect()] == [1]
    assert [r.category for r in mapview.category_list(businesses).collect()] == ["Bar", "Food", "Italian", "Pizza"]
    popups = {r.business_id: (r.categories, r.status) for r in mapview.popup(businesses).collect()}
    assert popups["a"] == ("Pizza,  Italian , Food", "Open") and popups["b"] == ("", "Closed")
    assert mapview.map_filter(businesses, category="ITAL", is_open=1).count() == 1
    means = {r.city: (r.latitude, r.longitude) for r in mapview.city_centroid(businesses).collect()}
    assert means["Philadelphia"] == (40.0, -75.1) and means["Reno"] == (None, None)


def test_clusters_sum_to_points(spark):
    points = spark.range(500).selectExpr("id business_id", "sin(id) * 170 + 0.001 longitude", "cos(id * 7) * 80 + 0.001 latitude")
    for zoom in (0, 3, 20):
        rows = mapview.clusters(points, zoom).collect()
        assert sum(r.point_count for r in rows) == 500
        assert all((r.expansion_zoom is None) == (r.point_count == 1) for r in rows)


REVIEWS = """{"review_id": "1", "business_id": "a", "date": "2024-01-05 10:00:00", "stars": 4}

not json
{"review_id": "2", "business_id": "zzz", "date": "2024-01-05"}
{"review_id": "3", "business_id": "a", "date": ""}
{"review_id": "3", "business_id": "a", "date": "2015-9-3", "text": null}
{"review_id": "3", "business_id": "a", "date": "2015-09-04"}
{"review_id": "4", "business_id": "zzz", "date": "2015-13-01"}
{"review_id": "5", "business_id": "a", "date": "2015-13-01"}
{"business_id": "a", "date": "2015-01-01"}
"""


def test_ingest(spark, shop, tmp_path):
    (tmp_path / "r.json").write_text(REVIEWS)
    raw = readers.read_records(spark, str(tmp_path / "r.json"), schema.REVIEW)
    assert raw.count() == 8
    loaded = spark.createDataFrame([("4",)], "review_id string")
    rows = ingest.ingest_reviews(raw, shop[0].select("business_id"), loaded)
    assert [r.outcome for r in rows.orderBy("_ordinal").collect()] == ["inserted", "orphaned", "error", "inserted", "skipped", "skipped", "error", "error"]
    kept = {r.review_id: r for r in ingest.accepted(rows).collect()}
    assert (kept["3"].date, kept["3"].text, kept["3"].sentiment_label, kept["1"].stars) == (dt.date(2015, 9, 3), "", "neutral", 4.0)
    readers.write_table(ingest.accepted(rows), str(tmp_path / "out"))
    again = ingest.ingest_reviews(raw, shop[0].select("business_id"), spark.read.parquet(str(tmp_path / "out")).select("review_id"))
    assert {r.outcome: r.records for r in ingest.report(again).collect()} == {"skipped": 4, "orphaned": 2, "error": 2}


def test_a_hot_key_is_one_insert(spark):
    """A key in most records, null keys and null parents: the first record wins, and no task of a join has them all."""
    raw = spark.range(6_000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 'hot', concat('p', id))) photo_id", "'a' business_id", "'x' label", "id _ordinal").repartition(7)
    rows = ingest.ingest_photos(raw, spark.createDataFrame([("a",)], "business_id string"))
    assert {r.outcome: r.records for r in ingest.report(rows).collect()} == {"error": 2_000, "inserted": 2_001, "skipped": 1_999}
    assert [r._ordinal for r in rows.filter("photo_id = 'hot' and outcome = 'inserted'").collect()] == [1]


def test_ingest_businesses_and_photos(spark, tmp_path):
    (tmp_path / "b.json").write_text('[{"business_id": "a", "name": "n", "city": "c", "state": "s", "latitude": 1, "longitude": 2, "hours": {"Mon": "9-5"}},\n {"business_id": "b", "name": "n"}]')
    rows = ingest.ingest_businesses(readers.read_records(spark, str(tmp_path / "b.json"), schema.BUSINESS)).orderBy("business_id").collect()
    assert [r.outcome for r in rows] == ["inserted", "error"]
    assert (rows[0].is_open, rows[0].categories, rows[0].attributes, rows[0].hours) == (1, "", {}, {"Mon": "9-5"})
    photos = spark.createDataFrame([("p", "a", None, 0), ("q", "x", "food", 1)], "photo_id string, business_id string, label string, _ordinal long")
    got = ingest.ingest_photos(photos, spark.createDataFrame([("a",)], "business_id string")).orderBy("photo_id").collect()
    assert [(r.label, r.outcome) for r in got] == [("unknown", "inserted"), ("food", "orphaned")]
    assert ingest.out_of_range(spark.createDataFrame([(5.5,), (None,), (5.0,)], "stars double")).count() == 1


def test_readers(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_records(spark, str(tmp_path / "none.json"), schema.PHOTO)
    (tmp_path / "bad.json").write_text('{"photo_id": "1"}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.read_strict(spark, str(tmp_path / "bad.json"), schema.PHOTO).collect()


def test_embeddings(spark):
    rows = spark.createDataFrame([(1, "good food here"), (2, "good food here"), (3, None)], "review_id int, text string")
    found = {r.review_id: r.embedding for r in embed.hashed_embedding(rows).collect()}
    assert found[1] == found[2] and math.isclose(sum(x * x for x in found[1]), 1, rel_tol=1e-5) and not any(found[3])
    own = embed.encode(rows, lambda: lambda texts: [[3.0, 4.0 if t else 0.0] for t in texts]).orderBy("review_id").collect()
    assert [round(x, 4) for x in own[0].embedding] == [0.6, 0.8] and list(own[2].embedding) == [1.0, 0.0]
    assert embed.metadata(rows.withColumn("stars", F.lit(1))).columns == ["review_id", "stars"]


def test_saved_vectors(spark, tmp_path):
    rows = embed.hashed_embedding(spark.createDataFrame([(1, "good food"), (2, "bad food")], "review_id int, text string"))
    embed.save_vectors(rows, str(tmp_path / "v"))
    assert sorted(map(tuple, embed.load_vectors(spark, str(tmp_path / "v"), 2).collect())) == sorted(map(tuple, rows.collect()))
    for bad in (rows.withColumn("embedding", F.expr("if(review_id = 1, embedding, null)")), rows.withColumn("embedding", F.expr("slice(embedding, 1, 60 + review_id)"))):
        embed.save_vectors(bad, str(tmp_path / "bad"))
        with pytest.raises(ValueError, match="vectors"):
            embed.load_vectors(spark, str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="2 rows"):
        embed.load_vectors(spark, str(tmp_path / "v"), 3)


def test_encoder_gets_batches(spark):
    rows = spark.range(10).selectExpr("id review_id", "'x' text").coalesce(1)
    got = embed.encode(rows, lambda: lambda texts: [[1.0, float(len(texts))] for _ in texts], batch_size=4).orderBy("review_id").collect()
    assert [round(r.embedding[1] / r.embedding[0]) for r in got] == [4] * 8 + [2] * 2


def test_batch_sizes_by_memory(spark):
    assert [embed.batch_size_for(g) for g in (80, 15, 14.9, 12, 11, 0)] == [1_024, 1_024, 768, 768, 512, 512] and embed.memory_here() > 0
    rows = spark.range(600).selectExpr("id review_id", "'x' text").coalesce(1)
    got = embed.encode(rows, lambda: lambda texts: [[1.0, float(len(texts))] for _ in texts], memory=lambda: 3.0)
    assert sorted({round(r.embedding[1] / r.embedding[0]) for r in got.collect()}) == [88, 512]


def test_clusters_in_a_box_are_those_of_the_whole_map(spark):
    points = spark.range(3_000).selectExpr("id business_id", "sin(id) * 178 + 0.001 longitude", "cos(id * 7) * 84 + 0.001 latitude")
    for zoom in (0, 2, 5, 9):
        whole = mapview.clusters(points, zoom).collect()
        for box in ((-20.0, -10.0, 30.0, 15.0), (100.0, 50.0, 179.0, 84.9), (-180.0, -85.0, -100.0, 0.0)):
            want = [r for r in whole if box[0] <= r.longitude <= box[2] and box[1] <= r.latitude <= box[3]]
            assert sorted(map(str, mapview.clusters(points, zoom, box).collect())) == sorted(map(str, want))


def test_service(shop):
    api = ReviewService(*shop)
    assert api.business("a")["name"] == "Joe's Pizza" and api.states() == ["NV", "PA"] and api.cities("pa") == ["Erie", "Philadelphia"]
    assert [r["business_id"] for r in api.list("pa", limit=2)] == ["c", "a"]
    found = api.comparison("a", "city", period="year")
    assert found["city"] == "Philadelphia" and len(found["business_data"]) == 1 and len(found["city_average"]) == 2
    assert api.area_timeline("pa")["data"] == [] and len(api.area_timeline("PA")["data"]) == 2
    assert api.business_timeline("a", "sentiment")["data"][0]["period_start"] == "2024-01-01"
    assert "relevance" not in api.search("pizza")[0]
    assert api.root()["status"] == api.health()["status"] == "healthy"
    assert set(found) >= {"metric", "start_date", "end_date"} and api.area_timeline("PA")["metric"] == api.business_timeline("a")["metric"] == "rating"
    for status, call in (
        (404, lambda: api.business("?")), (404, lambda: api.business_timeline("?")), (400, lambda: api.business_timeline("a", period="hour")), (400, lambda: api.comparison("a", "city", "votes")),
        (400, lambda: api.viewport(2, 0, 1, 5)), (422, lambda: api.viewport(0, 0, 91, 5)), (422, lambda: api.list(limit=1_001)), (422, lambda: api.search("")), (422, lambda: api.cities("PAX")),
    ):
        with pytest.raises(ServiceError) as e:
            call()
        assert e.value.status == status
