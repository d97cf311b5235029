"""DuckDB SQL for the queries of plans/queries.py."""

from __future__ import annotations

from ..functions.trigram import like_pattern, trigrams_of
from ..operators.timeline import METRICS, PERIODS
from .queries import BUSINESS, CITY, PAGE_ORDER, SEARCHES, STATE, WINDOW

_BUSINESSES = "(SELECT s_suppkey AS business_id, s_name AS name, n_name AS city, r_name AS state, s_acctbal AS stars, 0 AS review_count FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_REVIEWS = "(SELECT l_orderkey AS review_id, l_suppkey AS business_id, CAST(l_shipdate AS DATE) AS date, l_quantity AS stars, l_discount AS sentiment_score_prob_diff, l_tax AS sentiment_score_expected FROM lineitem)"
_ORDERS = "(SELECT o_orderkey AS review_id, o_custkey AS business_id, CAST(o_orderdate AS DATE) AS date, o_totalprice AS stars FROM orders)"
_PARTS = "(SELECT p_partkey AS business_id, p_name AS name, p_type AS city, p_brand AS state, p_name || ', ' || p_type || ', ' || p_brand AS categories, p_retailprice AS stars, p_size AS review_count FROM part)"
_PLACES = "(SELECT vec_id AS business_id, CAST(embedding[1] AS DOUBLE) * 180 AS longitude, CAST(embedding[2] AS DOUBLE) * 85 AS latitude, label AS stars, vec_id AS review_count FROM embeddings)"
_BEST = "stars DESC NULLS FIRST, review_count DESC NULLS FIRST, business_id"
_IN = {"business": f"business_id = {BUSINESS}", "city": f"business_id IN (SELECT business_id FROM {_BUSINESSES} WHERE city = '{CITY}' AND state = '{STATE}')", "state": f"business_id IN (SELECT business_id FROM {_BUSINESSES} WHERE state = '{STATE}')"}


def _timeline(where: str, metric: str, period: str, more: str = "") -> str:
    averages = ", ".join(f"round(coalesce(round(sum({c}), 6) / nullif(count({c}), 0), 0), 6) AS {n}" for n, c in METRICS[metric].items())
    return f"SELECT CAST(date_trunc('{period}', date) AS DATE) AS period_start, {averages}, count(review_id) AS review_count{more} FROM {_REVIEWS} WHERE {where} GROUP BY 1"


def _compare(kind: str, metric: str) -> str:
    own = f"(SELECT * FROM {_BUSINESSES} WHERE business_id = {BUSINESS})"
    same = f"state = (SELECT state FROM {own})" + (f" AND city = (SELECT city FROM {own})" if kind == "city" else "")
    peers = f"business_id IN (SELECT business_id FROM {_BUSINESSES} WHERE {same})"
    a = _timeline(_IN["business"], metric, "month", ", CAST(1 AS BIGINT) AS business_count, 'business' AS data_type")
    return f"{a} UNION ALL {_timeline(peers, metric, 'month', f", count(DISTINCT business_id) AS business_count, '{kind}' AS data_type")}"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _trigrams(c: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda k: substr('  ' || w || ' ', k, 3)))))"


def _similar(c: str, query: str) -> str:
    grams = trigrams_of(query)
    if not grams:
        return "CAST(0 AS DOUBLE)"
    both = f"len(list_intersect({c}_t, [{', '.join(map(_text, grams))}]))"
    return f"CAST(CAST({both} / CAST(len({c}_t) + {len(grams)} - {both} AS DOUBLE) AS FLOAT) AS DOUBLE)"


def _search(query: str, skip: int = 0) -> str:
    q = query.strip().lower()
    like = lambda c, t: f"{c} ILIKE {_text(like_pattern(t))} ESCAPE '\\'"
    tests = [like(c, t) for t in q.split() for c in ("name", "city", "state", "categories")] + [f"{_similar(c, t)} > CAST(0.3 AS DOUBLE)" for t in q.split() for c in ("name", "city", "categories")]
    score = f"CASE WHEN lower(name) = {_text(q)} THEN 100 WHEN lower(city) = {_text(q)} THEN 90 WHEN lower(state) = {_text(q)} THEN 85 ELSE 0 END"
    score += "".join(f" + {_similar(c, q)} * {w}" for c, w in (("name", 50), ("city", 40), ("categories", 30)))
    score += f" + CASE WHEN {like('name', q)} THEN 20 WHEN {like('city', q)} THEN 15 WHEN {like('categories', q)} THEN 10 ELSE 0 END"
    rows = f"(SELECT *, {', '.join(f'{_trigrams(c)} AS {c}_t' for c in ('name', 'city', 'categories'))} FROM {_PARTS})"
    return f"SELECT business_id, name, relevance FROM (SELECT *, round(CAST({score} AS DOUBLE), 6) AS relevance FROM {rows} WHERE {' OR '.join(tests) or 'true'}) ORDER BY relevance DESC, {_BEST} LIMIT 20 OFFSET {skip}"


def _clusters(zoom: int, bbox: tuple[float, float, float, float]) -> str:
    cell = lambda c, k: f"floor({c} * (512 / 75.0::DOUBLE) * pow(2.0::DOUBLE, {k}))"
    s = "sin(radians(latitude))"
    points = f"(SELECT *, (longitude + 180) / 360 AS x, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE - ln((1 + {s}) / (1 - {s})) / (4 * pi()))) AS y FROM {_PLACES} WHERE latitude <> 0 AND longitude <> 0)"
    cells = f"(SELECT CAST({cell('x', zoom)} AS BIGINT) AS cell_x, CAST({cell('y', zoom)} AS BIGINT) AS cell_y, count(*) AS point_count, round(avg(longitude), 6) AS longitude, round(avg(latitude), 6) AS latitude, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {points} GROUP BY 1, 2)"
    parts = f"list_filter(range({zoom}, 21), lambda k: {cell('x0', 'k')} <> {cell('x1', 'k')} OR {cell('y0', 'k')} <> {cell('y1', 'k')})"
    return f"SELECT cell_x, cell_y, point_count, point_count > 1 AS is_cluster, longitude, latitude, CAST(CASE WHEN point_count > 1 THEN coalesce({parts}[1], 20) END AS INTEGER) AS expansion_zoom FROM {cells} WHERE longitude BETWEEN {bbox[0]} AND {bbox[2]} AND latitude BETWEEN {bbox[1]} AND {bbox[3]}"


_OUTCOMES = f"(SELECT r.*, CASE WHEN o_orderstatus = 'F' THEN 'skipped' WHEN c_custkey IS NULL THEN 'orphaned' ELSE 'inserted' END AS outcome FROM {_ORDERS} r JOIN orders o ON o.o_orderkey = r.review_id LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) ON c_custkey = r.business_id)"
_CREDIT = "IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)"
_LOADED = f"""SELECT 'businesses' AS table_name, 'skipped' AS outcome, count(*) AS n FROM customer WHERE c_acctbal >= 0
  UNION ALL SELECT 'photos', CASE WHEN p_partkey {_CREDIT} THEN 'inserted' ELSE 'orphaned' END, count(*) FROM part GROUP BY 2
  UNION ALL SELECT 'reviews', CASE WHEN o_custkey NOT {_CREDIT} THEN 'orphaned' WHEN o_orderstatus = 'F' THEN 'skipped' ELSE 'inserted' END, count(*) FROM orders GROUP BY 2"""
_NORM = "list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"
_COUNT = ", count(DISTINCT business_id) AS business_count"

ORACLE_SQL: dict[str, str] = {f"business_ratings_{p}": _timeline(_IN["business"], "rating", p) for p in PERIODS}
for _kind, _where in _IN.items():
    _more = "" if _kind == "business" else _COUNT
    ORACLE_SQL[f"{_kind}_ratings_month"] = _timeline(_where, "rating", "month", _more)
    ORACLE_SQL[f"{_kind}_sentiment_month"] = _timeline(_where, "sentiment", "month", _more)
    ORACLE_SQL[f"{_kind}_ratings_week_window"] = _timeline(f"{_where} AND date >= DATE '{WINDOW[0]}' AND date <= DATE '{WINDOW[1]}'", "rating", "week", _more)
ORACLE_SQL |= {f"compare_{k}_{m}": _compare(k, m) for k in ("city", "state") for m in ("rating", "sentiment")}
ORACLE_SQL |= {f"cube_{n}": ORACLE_SQL[n] for n in ("city_ratings_month", "state_sentiment_month", "compare_city_rating")}
ORACLE_SQL |= {f"search_{n}": _search(q) for n, q in SEARCHES.items()}
ORACLE_SQL |= {f"search_indexed_{n}": _search(SEARCHES[n]) for n in ("typo", "terms", "wildcard")}
ORACLE_SQL |= {
    "search_page": _search("red", 20),
    "business_by_id": f"SELECT * FROM {_BUSINESSES} WHERE business_id = {BUSINESS}",
    "review_by_id": f"SELECT * FROM {_ORDERS} WHERE review_id = 42",
    "reviews_by_business": f"SELECT * FROM {_ORDERS} WHERE business_id = {BUSINESS} ORDER BY date DESC NULLS FIRST, review_id LIMIT 10 OFFSET 1",
    "list_businesses": f"SELECT * FROM {_PARTS} ORDER BY {_BEST} LIMIT 100",
    "list_businesses_state": f"SELECT * FROM {_PARTS} WHERE state = 'Brand#2' ORDER BY {_BEST} LIMIT 100",
    "list_businesses_page": f"SELECT * FROM {_PARTS} WHERE state = 'Brand#2' AND city = 'ECONOMY' ORDER BY {_BEST} LIMIT 10 OFFSET 3",
    "states": f"SELECT DISTINCT state FROM {_BUSINESSES}",
    "cities_by_state": f"SELECT DISTINCT city FROM {_BUSINESSES} WHERE state = '{STATE}'",
    "viewport": f"SELECT * FROM {_PLACES} WHERE latitude BETWEEN -10 AND 10 AND longitude BETWEEN -20 AND 20 ORDER BY {_BEST} LIMIT 1000",
    "map_filter": f"SELECT business_id, name FROM {_PARTS} WHERE city = 'ECONOMY' AND contains(lower(categories), 'widget')",
    "map_total": f"SELECT count(*) AS total FROM {_PARTS} WHERE city = 'ECONOMY' AND contains(lower(categories), 'widget')",
    "map_clusters": _clusters(4, (-180, -85, 180, 85)),
    "map_clusters_bbox": _clusters(2, (-20, -10, 30, 15)),
    "city_centroid": f"SELECT stars, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude FROM {_PLACES} GROUP BY stars",
    "category_list": f"SELECT DISTINCT trim(c) AS category FROM (SELECT unnest(string_split(categories, ',')) AS c FROM {_PARTS}) WHERE trim(c) <> '' ORDER BY category LIMIT 200",
    "popup_categories": f"SELECT business_id, array_to_string(string_split(categories, ',')[1:3], ', ') AS categories, 'Open' AS status FROM {_PARTS}",
    "table_counts": "SELECT 'businesses' AS table_name, count(*) AS row_count FROM supplier UNION ALL SELECT 'photos', count(*) FROM part UNION ALL SELECT 'reviews', count(*) FROM lineitem",
    "ingest_report": f"SELECT outcome, count(*) AS records FROM {_OUTCOMES} GROUP BY outcome",
    "ingest_accepted": f"SELECT review_id, business_id, date, stars FROM {_OUTCOMES} WHERE outcome = 'inserted'",
    "ingest_orphans": f"SELECT review_id, business_id FROM {_OUTCOMES} WHERE outcome = 'orphaned'",
    "json_map": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "emb_metadata": "SELECT o_orderkey AS review_id, o_custkey AS business_id, o_totalprice AS stars, CAST(o_orderdate AS DATE) AS date FROM orders",
    "emb_alignment": f"SELECT count(embedding) AS vectors, CAST(min(len(embedding)) AS BIGINT) AS least_dim, CAST(max(len(embedding)) AS BIGINT) AS most_dim, CAST(sum(CAST(abs({_NORM} - 1) > 1e-5 AS BIGINT)) AS BIGINT) AS not_unit FROM embeddings",
    "emb_normalized": f"SELECT vec_id, dim, CAST(place AS INTEGER) AS place, CAST(CAST(e[place + 1] / norm AS FLOAT) AS DOUBLE) AS value FROM (SELECT vec_id, e, CAST(len(e) AS BIGINT) AS dim, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm, unnest(range(0, len(e))) AS place FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 3) AS e FROM embeddings))",
    "emb_aligned": "SELECT vec_id, label, position, CAST(place AS INTEGER) AS place, CAST(embedding[place + 1] AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS position, unnest(range(0, len(embedding))) AS place FROM embeddings)",
    "load_report": f"SELECT table_name, outcome, CAST(coalesce(n, 0) AS BIGINT) AS records FROM (VALUES ('businesses'), ('photos'), ('reviews')) t(table_name) CROSS JOIN (VALUES ('inserted'), ('skipped'), ('orphaned'), ('error')) o(outcome) LEFT JOIN ({_LOADED}) USING (table_name, outcome)",
    "loaded_reviews": "SELECT CAST(o_orderkey AS VARCHAR) AS review_id, CAST(o_custkey AS VARCHAR) AS business_id, CAST(o_orderdate AS DATE) AS date, o_totalprice AS stars, 'neutral' AS sentiment_label FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)",
    "deep_page": f"SELECT {', '.join(c for c, _ in PAGE_ORDER)} FROM lineitem ORDER BY {', '.join(f'{c} DESC NULLS FIRST' if down else f'{c} NULLS FIRST' for c, down in PAGE_ORDER)} LIMIT 1000 OFFSET (SELECT count(*) * 9 // 10 FROM lineitem)",
    "categories_first_seen": "SELECT value, row, CAST(nth AS INTEGER) AS nth FROM (SELECT trim(parts[nth + 1]) AS value, row, nth, row_number() OVER (PARTITION BY trim(parts[nth + 1]) ORDER BY row, nth) AS k FROM (SELECT row, parts, unnest(range(0, len(parts))) AS nth FROM (SELECT row_number() OVER () - 1 AS row, string_split(p_name || ' , ' || p_type || ' , ' || p_brand, ',') AS parts FROM part))) WHERE k = 1 AND value <> '' ORDER BY row, nth LIMIT 200",
    "json_arrays": "SELECT event_id, event_type, round(value, 6) AS value, json_extract_string(props, '$.k') AS k FROM events",
    "emb_hashed": "SELECT count(*) AS vectors, CAST(64 AS BIGINT) AS least_dim, CAST(64 AS BIGINT) AS most_dim, CAST(sum(CAST(NOT regexp_matches(coalesce(text, ''), '\\S') AS BIGINT)) AS BIGINT) AS not_unit FROM documents",
}
ORACLE_SQL["viewport_stored"] = ORACLE_SQL["viewport"]
