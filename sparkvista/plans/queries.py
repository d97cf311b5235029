"""The engine's queries over the provided tables, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import discovery, embed, ingest, mapview
from ..operators.cluster_tree import cluster_tree
from ..operators.load import Warehouse, outcome_rows
from ..operators.pages import deep_page
from ..operators.period_cube import PeriodCube
from ..operators.search_index import SearchIndex
from ..operators.timeline import PERIODS, Scope, compare, timeline
from ..operators.viewport_store import ViewportStore
from ..sources import domain, schema
from ..sources.readers import read_records, string_map
from ..sources.store import fresh_dir

Query = Callable[[SparkSession, str], DataFrame]
BUSINESS, CITY, STATE = 7, "NATION_18", "EUROPE"
WINDOW = ("1996-03-15", "1998-09-02")
SEARCHES = {"exact": "red widget", "typo": "wdget", "terms": "red economy", "brand": "brand#17", "blank": "  ", "wildcard": "sm_ll%r", "backslash": "ring\\"}


def _timeline(spark: SparkSession, d: str, scope: Scope, metric: str, period: str, bounds: tuple = (None, None)) -> DataFrame:
    return timeline(domain.reviews(spark, d), scope, metric, period, *bounds, businesses=domain.businesses(spark, d))


def _compare(spark: SparkSession, d: str, kind: str, metric: str) -> DataFrame:
    return compare(domain.reviews(spark, d), domain.businesses(spark, d), BUSINESS, kind, metric, "month")


def _cube(spark: SparkSession, d: str) -> PeriodCube:
    """Line items in two parts, as if those of later days had come later."""
    cube, reviews = PeriodCube.create(domain.businesses(spark, d), fresh_dir(spark, "cube")), domain.reviews(spark, d)
    cube.append(reviews.filter("date < '1998-05-13'"), "first")
    cube.append(reviews.filter("date >= '1998-05-13'"), "later")
    return cube


def _ingest(spark: SparkSession, d: str) -> DataFrame:
    """Orders as records: finished ones are loaded already, and customers in debt are unknown."""
    orders = domain.table(spark, d, "orders")
    raw = orders.select(F.col("o_orderkey").alias("review_id"), F.col("o_custkey").alias("business_id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date"), F.col("o_totalprice").alias("stars"), F.col("o_orderkey").alias("_ordinal"))
    loaded = orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("review_id"))
    known = domain.table(spark, d, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("business_id"))
    return ingest.ingest_reviews(raw, known, loaded)


def _warehouse(spark: SparkSession, d: str) -> tuple[Warehouse, DataFrame]:
    """Customers in credit as businesses, parts as their photos, orders as their reviews, in two loads: finished orders come first, all of them again later."""
    customer, part, orders = (domain.table(spark, d, t) for t in ("customer", "part", "orders"))
    text = lambda c: F.col(c).cast("string")
    shops = customer.filter("c_acctbal >= 0").select(text("c_custkey").alias("business_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("city"), text("c_nationkey").alias("state"), F.col("c_acctbal").alias("latitude"), F.lit(1.0).alias("longitude"), F.col("c_custkey").alias("_ordinal"))
    photos = part.select(text("p_partkey").alias("photo_id"), text("p_partkey").alias("business_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("label"), F.col("p_partkey").alias("_ordinal"))
    reviews = orders.select(text("o_orderkey").alias("review_id"), text("o_custkey").alias("business_id"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date"), F.col("o_totalprice").alias("stars"), F.col("o_orderkey").alias("_ordinal"), F.col("o_orderstatus").alias("status"))
    wide = lambda df, kind: df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kind], "_ordinal")
    house = Warehouse(spark, fresh_dir(spark, "warehouse"))
    house.load(wide(shops, schema.BUSINESS), None, wide(reviews.filter("status = 'F'"), schema.REVIEW))
    state = house.load(wide(shops, schema.BUSINESS), wide(photos, schema.PHOTO), wide(reviews, schema.REVIEW))
    return house, outcome_rows(spark, state)


def _search(spark: SparkSession, d: str, query: str, skip: int = 0) -> DataFrame:
    return discovery.search(domain.catalogue(spark, d), query, skip).select("business_id", "name", "relevance")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Each vector, three times as long, brought to length 1 again."""
    rows = domain.table(spark, d, "embeddings").select("vec_id", embed.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return rows.select("vec_id", F.size("v").cast("long").alias("dim"), F.posexplode("v").alias("place", "value")).withColumn("value", F.col("value").cast("double"))


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as .npy files and their metadata as Parquet, both read again and joined by position."""
    path = fresh_dir(spark, "aligned")
    embed.save_aligned(domain.table(spark, d, "embeddings"), path, ["vec_id"])
    rows = embed.load_aligned(spark, f"{path}/vectors", f"{path}/metadata")
    return rows.select("vec_id", "label", "position", F.posexplode("embedding").alias("place", "value")).withColumn("value", F.col("value").cast("double"))


def _json_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Events as files that are one JSON array each, read again in splits; props are JSON within JSON strings."""
    path = fresh_dir(spark, "arrays")
    record = F.struct("event_id", "event_type", F.struct("value", "props").alias("data"))
    arrays = domain.table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 5_000).alias("part")).agg(F.to_json(F.collect_list(record)).alias("value"))
    arrays.write.partitionBy("part").text(path)
    kind = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("data", T.StructType([T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())]))])
    rows = read_records(spark, path, kind)
    return rows.select("event_id", "event_type", F.round("data.value", 6).alias("value"), F.element_at(string_map(F.col("data.props")), "k").alias("k"))


PAGE_ORDER = [("l_quantity", True), ("l_extendedprice", True), ("l_orderkey", False), ("l_linenumber", False), ("l_partkey", False), ("l_suppkey", False), ("l_discount", False)]


def _deep_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of 1,000 rows at nine tenths of all line items."""
    rows = domain.table(spark, d, "lineitem").select(*[c for c, _ in PAGE_ORDER])
    return deep_page(rows, PAGE_ORDER, rows.count() * 9 // 10, 1_000)


def _first_seen(spark: SparkSession, d: str) -> DataFrame:
    rows = domain.placed(spark, f"{d}/part.parquet").select(F.concat_ws(" , ", "p_name", "p_type", "p_brand").alias("categories"), "_place")
    return mapview.first_seen(rows).select("value", F.col("place.row").alias("row"), "nth")


def _indexed(spark: SparkSession, d: str, query: str) -> DataFrame:
    return SearchIndex.write(domain.catalogue(spark, d), fresh_dir(spark, "search-index")).search(query).select("business_id", "name", "relevance")


QUERIES: dict[str, Query] = {}
for _p in PERIODS:
    QUERIES[f"business_ratings_{_p}"] = partial(_timeline, scope=Scope("business", BUSINESS), metric="rating", period=_p)
for _kind, _scope in (("business", Scope("business", BUSINESS)), ("city", Scope("city", city=CITY, state=STATE)), ("state", Scope("state", state=STATE))):
    QUERIES[f"{_kind}_ratings_month"] = partial(_timeline, scope=_scope, metric="rating", period="month")
    QUERIES[f"{_kind}_sentiment_month"] = partial(_timeline, scope=_scope, metric="sentiment", period="month")
    QUERIES[f"{_kind}_ratings_week_window"] = partial(_timeline, scope=_scope, metric="rating", period="week", bounds=WINDOW)
for _kind in ("city", "state"):
    for _metric in ("rating", "sentiment"):
        QUERIES[f"compare_{_kind}_{_metric}"] = partial(_compare, kind=_kind, metric=_metric)
for _name, _q in SEARCHES.items():
    QUERIES[f"search_{_name}"] = partial(_search, query=_q)
for _name in ("typo", "terms", "wildcard"):
    QUERIES[f"search_indexed_{_name}"] = partial(_indexed, query=SEARCHES[_name])
QUERIES |= {
    "json_arrays": _json_arrays,
    "viewport_stored": lambda s, d: ViewportStore.write(domain.places(s, d), fresh_dir(s, "places")).in_viewport(-10.0, -20.0, 10.0, 20.0),
    "deep_page": _deep_page,
    "categories_first_seen": _first_seen,
    "cube_city_ratings_month": lambda s, d: _cube(s, d).timeline(Scope("city", city=CITY, state=STATE)),
    "cube_state_sentiment_month": lambda s, d: _cube(s, d).timeline(Scope("state", state=STATE), "sentiment"),
    "cube_compare_city_rating": lambda s, d: _cube(s, d).compare(BUSINESS, "city"),
    "map_cluster_tree": lambda s, d: cluster_tree(domain.places(s, d)),
    "load_report": lambda s, d: _warehouse(s, d)[1],
    "loaded_reviews": lambda s, d: _warehouse(s, d)[0].table("reviews").select("review_id", "business_id", "date", "stars", "sentiment_label"),
    "search_page": partial(_search, query="red", skip=20),
    "business_by_id": lambda s, d: discovery.by_id(domain.businesses(s, d), "business_id", BUSINESS),
    "review_by_id": lambda s, d: discovery.by_id(domain.order_reviews(s, d), "review_id", 42),
    "reviews_by_business": lambda s, d: discovery.reviews_of(domain.order_reviews(s, d), BUSINESS, 1, 10),
    "list_businesses": lambda s, d: discovery.list_businesses(domain.catalogue(s, d)),
    "list_businesses_state": lambda s, d: discovery.list_businesses(domain.catalogue(s, d), state="Brand#2"),
    "list_businesses_page": lambda s, d: discovery.list_businesses(domain.catalogue(s, d), state="Brand#2", city="ECONOMY", skip=3, limit=10),
    "states": lambda s, d: discovery.states(domain.businesses(s, d)),
    "cities_by_state": lambda s, d: discovery.cities_of(domain.businesses(s, d), STATE),
    "viewport": lambda s, d: discovery.in_viewport(domain.places(s, d), -10.0, -20.0, 10.0, 20.0),
    "map_filter": lambda s, d: mapview.map_filter(domain.catalogue(s, d), city="ECONOMY", category="WIDGET").select("business_id", "name"),
    "map_total": lambda s, d: mapview.map_total(domain.catalogue(s, d), city="ECONOMY", category="WIDGET"),
    "map_clusters": lambda s, d: mapview.clusters(domain.places(s, d)),
    "map_clusters_bbox": lambda s, d: mapview.clusters(domain.places(s, d), 2.7, (-20.0, -10.0, 30.0, 15.0)),
    "city_centroid": lambda s, d: mapview.city_centroid(domain.places(s, d), "stars"),
    "category_list": lambda s, d: mapview.category_list(domain.catalogue(s, d)),
    "popup_categories": lambda s, d: mapview.popup(domain.catalogue(s, d)),
    "table_counts": lambda s, d: ingest.table_counts(businesses=domain.table(s, d, "supplier"), photos=domain.table(s, d, "part"), reviews=domain.table(s, d, "lineitem")),
    "ingest_report": lambda s, d: ingest.report(_ingest(s, d)),
    "ingest_accepted": lambda s, d: ingest.accepted(_ingest(s, d)).select("review_id", "business_id", "date", "stars"),
    "ingest_orphans": lambda s, d: _ingest(s, d).filter("outcome = 'orphaned'").select("review_id", "business_id"),
    "json_map": lambda s, d: domain.table(s, d, "events").select("event_id", F.element_at(string_map(F.col("props")), "k").alias("k")),
    "emb_metadata": lambda s, d: embed.metadata(domain.order_reviews(s, d)),
    "emb_alignment": lambda s, d: embed.check_vectors(domain.table(s, d, "embeddings")),
    "emb_normalized": _vectors,
    "emb_aligned": _aligned,
    "emb_hashed": lambda s, d: embed.check_vectors(embed.hashed_embedding(domain.table(s, d, "documents").select("doc_id", "text"))),
}

#: Queries whose time is mostly that of building what they read.
BUILDS = tuple(n for n in QUERIES if n.startswith(("search_indexed_", "cube_", "load")) or n in ("json_arrays", "map_cluster_tree", "viewport_stored", "emb_aligned"))
