"""The tree of clusters against a sequential greedy pass over the points in the order of their keys."""

import math

import pytest
from pyspark.sql import functions as F

from sparkvista.operators import cluster_tree as ct
from sparkvista.sources import domain

SF = "/root/testdata/sf0.001"


def sequential(points, max_zoom):
    """points: (key, x, y) in whole units. For each zoom the nodes {(key, formed): (n, x, y)}, and parents."""
    nodes, shown, parents = {(k, max_zoom + 1): (1, x, y) for k, x, y in points}, {}, {}
    for zoom in range(max_zoom, -1, -1):
        left, out, r = dict(sorted(nodes.items())), {}, ct.reach(zoom)
        while left:
            name = next(iter(left))
            n, x, y = left.pop(name)
            near = [m for m, (_, a, b) in left.items() if (a - x) ** 2 + (b - y) ** 2 <= r * r]
            if not near:
                out[name] = (n, x, y)
                continue
            took = [(n, x, y)] + [left.pop(m) for m in near]
            total, made = sum(t[0] for t in took), (name[0], zoom)
            out[made] = (total, sum(t[0] * t[1] for t in took) // total, sum(t[0] * t[2] for t in took) // total)
            parents |= {m: made for m in [name, *near]}
        nodes = shown[zoom] = out
    return shown, parents


def units(df):
    x, y = ct.mercator()
    return [tuple(r) for r in ct.located(df).select("business_id", F.floor(x * ct.UNITS), F.floor(y * ct.UNITS)).collect()]


def place(x, y):
    return round(x / ct.UNITS * 360 - 180, 6), round(math.degrees(2 * math.atan(math.exp((0.5 - y / ct.UNITS) * 2 * math.pi))) - 90, 6)


def check(df, max_zoom=20):
    points = units(df)
    shown, parents = sequential(points, max_zoom)
    tree = ct.stored(ct.cluster_tree(df, max_zoom=max_zoom), "tree")
    rows = {(r["rank"], r.formed): r for r in tree.collect()}
    assert {k: (r.parent_rank, r.parent_formed) for k, r in rows.items() if r.parent_rank is not None} == parents
    for zoom in range(max_zoom + 1):
        want = {k: (n, *place(x, y)) for k, (n, x, y) in shown[zoom].items()}
        got = {k: (r.point_count, round(r.longitude, 6), round(r.latitude, 6)) for k, r in rows.items() if r.formed >= zoom and (r.parent_formed is None or r.parent_formed < zoom)}
        assert got == want, zoom
    below = {k: set() for k in rows}
    for key, _, _ in points:
        node = (key, max_zoom + 1)
        while node:
            below[node].add(key)
            node = parents.get(node)
    where = {r.first_leaf: k[0] for k, r in rows.items() if k[1] == max_zoom + 1}
    assert sorted(where) == list(range(len(points)))
    for k, r in rows.items():
        assert {where[i] for i in range(r.first_leaf, r.last_leaf + 1)} == below[k] and r.point_count == len(below[k])
        assert r.expansion_zoom == (min(k[1] + 1, max_zoom) if k[1] <= max_zoom else None)
    return tree


def test_places(spark):
    tree = check(domain.places(spark, SF))
    shown = ct.clusters_at(tree, 3.7, (-20.0, -10.0, 30.0, 15.0)).collect()
    assert shown and all(-20 <= r.longitude <= 30 and r.formed >= 3 for r in shown)
    big = max(shown, key=lambda r: r.point_count)
    assert ct.leaves(tree, big.first_leaf, big.last_leaf).count() == big.point_count
    assert sum(r.point_count for r in ct.children(tree, big["rank"], big.formed).collect()) == big.point_count


def test_odd_points(spark):
    """Points in one place, a dense spot, points at the edge of the radius, and coordinates that are none."""
    rows = [(k, 10.0, 20.0) for k in range(6)] + [(100 + k, 10.0 + k * 1e-7, 20.0) for k in range(40)] + [(200 + k, -30.0 + 52.734375 * k, 5.0) for k in range(3)]
    rows += [(300, None, 1.0), (301, float("nan"), 1.0), (302, 0.0, 1.0), (303, 179.99, 84.9), (304, -179.99, -84.9)]
    df = spark.createDataFrame(rows, "business_id long, longitude double, latitude double")
    check(df, 8)
    assert ct.cluster_tree(df.limit(0)).count() == 0


def test_a_dense_cell_meets_candidates_only(spark):
    """Of 3,000 points in one cell a round compares each with the candidates of 25 cells, not with each other."""
    rows = spark.range(3_000).selectExpr("id rank", "1000 + id % 50 x", "1000 + id % 40 y")
    cells = ct._cells(rows, 10_000)
    first = cells.groupBy("cx", "cy").agg(F.min(F.struct("rank", "x", "y")).alias("c")).select("cx", "cy", "c.*")
    assert cells.join(ct._around(first), ["cx", "cy"]).count() == 3_000
    assert {r.centre for r in ct.assign(rows, 20_000).collect()} == {0}


def test_rounds_send_nothing_through_the_driver(spark, monkeypatch):
    """No join of the rounds broadcasts a side; of the numbering, one row for each task."""
    plans, stored = [], ct.stored

    def kept(df, tag):
        plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        return stored(df, tag)

    monkeypatch.setattr(ct, "stored", kept)
    df = spark.range(60).selectExpr("id business_id", "10 + (id * 7 % 60) / 4 longitude", "20.0 latitude")
    plans.append(("tree", ct.cluster_tree(df, max_zoom=2)._jdf.queryExecution().executedPlan().toString()))
    assert {"centres", "undecided", "assigned", "paths", "tree"} <= {t for t, _ in plans}
    assert [t for t, p in plans if "Broadcast" in p and t != "leaves"] == []


@pytest.mark.parametrize("zoom", [0, 4, 20])
def test_reach_is_whole(zoom):
    assert ct.reach(zoom) * (ct.EXTENT << zoom) == ct.RADIUS * ct.UNITS and ct._side(ct.reach(zoom)) * 2**0.5 <= ct.reach(zoom)
