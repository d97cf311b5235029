"""Deep pages against a full sort; values in the order in which a plain loop meets them."""

import duckdb
import pyarrow.parquet as pq
import pytest

from sparkvista.operators import mapview, pages
from sparkvista.plans.queries import PAGE_ORDER
from sparkvista.sources import domain

SF = "/root/testdata/sf0.01"


def test_pages_up_to_the_end(spark):
    rows = domain.table(spark, SF, "lineitem").select(*[c for c, _ in PAGE_ORDER])
    order = ", ".join(f"{c} DESC NULLS FIRST" if down else f"{c} NULLS FIRST" for c, down in PAGE_ORDER)
    want = duckdb.sql(f"SELECT {', '.join(rows.columns)} FROM '{SF}/lineitem.parquet' ORDER BY {order}").fetchall()
    for skip, limit in ((0, 3), (1_200, 40), (33_333, 100), (len(want) - 5, 10), (len(want), 5)):
        got = [tuple(r) for r in pages.deep_page(rows, PAGE_ORDER, skip, limit, bins=16, enough=200).collect()]
        assert got == want[skip : skip + limit], skip


def test_nulls_ties_and_few_rows(spark):
    values = [None, None, float("nan"), 3.0, 3.0, 3.0, 1.0, -2.0, 1e300, -1e300]
    rows = spark.createDataFrame([(v, k, str(k)) for k, v in enumerate(values)] + [(3.0, None, "x")], "stars double, n int, id string")
    order = [("stars", True), ("n", False), ("id", False)]
    whole = [r.id for r in rows.orderBy(*pages._sorts(order)).collect()]
    for enough in (0, 2, 100):
        for skip in (0, 2, 5, 10, 12):
            assert [r.id for r in pages.deep_page(rows, order, skip, 3, bins=3, enough=enough).collect()] == whole[skip : skip + 3]
    assert pages.deep_page(rows.limit(0), order, 0, 3).count() == 0


def test_few_rows_are_sorted(spark):
    """At the end of the table the rows that are left to sort are those of the page's bins."""
    rows = domain.table(spark, SF, "lineitem").select(*[c for c, _ in PAGE_ORDER])
    keys = [pages._key(c, down) for c, down in PAGE_ORDER]
    at = pages._bin_of(rows, keys, 59_000, 64, 500)
    assert rows.filter(at.rows()).count() <= 500 and at.before <= 59_000


@pytest.mark.parametrize("parts", [1, 7])
def test_first_seen_is_a_plain_loop(spark, tmp_path, parts):
    texts = ["b, a ,b", None, "", " ,c,a", "d"] + [f"x{k % 9},y" for k in range(60)]
    spark.createDataFrame([(t,) for t in texts], "categories string").repartition(parts).write.parquet(str(tmp_path / "t"))
    want = []
    for file in sorted((tmp_path / "t").glob("part-*")):
        for t in pq.read_table(file)["categories"].to_pylist():
            want += [c.strip() for c in (t or "").split(",") if c.strip()]
    want = list(dict.fromkeys(want))
    rows = domain.placed(spark, str(tmp_path / "t")).repartition(5)
    assert [r.value for r in mapview.first_seen(rows).collect()] == want
    assert [r.value for r in mapview.first_seen(rows, limit=3).collect()] == want[:3]
    assert {r.value for r in mapview.first_seen(rows, separator=None).collect()} == {t.strip() for t in texts if t and t.strip()}


def test_marker_size(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(0,), (5,), (10,)], "n int").select(mapview.marker_size(F.col("n"), 10).alias("s")).collect()
    assert [r.s for r in got] == [30, 55, 80] and spark.range(1).select(mapview.marker_size(F.lit(0), 0).alias("s")).first().s == 30
