"""The viewport store against a filter of all rows, and what it skips."""

import pyarrow.parquet as pq

from sparkvista.operators import discovery, viewport_store
from sparkvista.operators.viewport_store import ViewportStore, ranges_of

BOXES = [(-10.0, -20.0, 10.0, 20.0), (0.0, 0.0, 0.5, 0.5), (-90.0, -180.0, 90.0, 180.0), (39.9, 99.9, 40.1, 100.1), (5.0, 5.0, 5.0, 5.0), (10.0, 10.0, -10.0, -10.0)]


def interleaved(x, y):
    return sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(16))


def test_store(spark, tmp_path):
    points = spark.range(20_000).selectExpr("id business_id", "sin(id) * 180 longitude", "cos(id * 7) * 90 latitude", "id % 5 stars", "id review_count")
    odd = spark.createDataFrame([(-1, None, 1.0), (-2, float("nan"), 1.0), (-3, 180.0, 90.0), (-4, -180.0, -90.0), (-5, 5.0, 5.0)], "business_id long, longitude double, latitude double").selectExpr("*", "0L stars", "0L review_count")
    rows = points.unionByName(odd)
    store = ViewportStore.write(rows, str(tmp_path / "s"), files=16)
    assert store.rows.count() == 20_005
    for r in store.rows.filter("_code is not null").limit(200).collect():
        x, y = (min(65_535, int((v + s) / (2 * s) * 65_536)) for v, s in ((r.longitude, 180.0), (r.latitude, 90.0)))
        assert r._code == interleaved(x, y)
    groups = [f.metadata.row_group(k).column(f.schema_arrow.get_field_index("_code")).statistics for p in (tmp_path / "s").glob("*.parquet") for f in [pq.ParquetFile(p)] for k in range(f.metadata.num_row_groups)]
    read = []
    for box in BOXES:
        want = discovery.in_viewport(rows, *box, limit=30_000).collect()
        assert store.in_viewport(*box, limit=30_000).collect() == want
        read.append(sum(any(s.min is not None and s.min <= high and low <= s.max for low, high in ranges_of(*box)) for s in groups))
    assert read[1] <= 2 and read[3] <= 2 and read[0] < len(groups) / 2 and read[2] == len(groups) and read[5] == 0
    assert "_code" in str(store.within(*BOXES[1])._jdf.queryExecution().executedPlan().toString()).split("PushedFilters", 1)[1]


def test_ranges_cover_the_box():
    for box in BOXES[:5]:
        found = ranges_of(*box)
        assert len(found) <= viewport_store.RANGES and all(a <= b for a, b in found) and all(b + 1 < c for (_, b), (c, _) in zip(found, found[1:]))
        for lat in (box[0], box[2], (box[0] + box[2]) / 2):
            for lon in (box[1], box[3], (box[1] + box[3]) / 2):
                x, y = (min(65_535, int((v + s) / (2 * s) * 65_536)) for v, s in ((lon, 180.0), (lat, 90.0)))
                assert any(a <= interleaved(x, y) <= b for a, b in found)
