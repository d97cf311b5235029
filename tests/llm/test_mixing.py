import math
from collections import defaultdict

import pytest

from sparkvista.llm import mixing
from sparkvista.llm.common import table

NO_LABELS = "doc_id long, quality int, toxic int"


def targets(sizes, weights=(3, 1, 2), share=1.5, limit=2):
    """The iterative rule: hand out, stop at the limits, hand the excess out again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        level, more = left / sum(w[s] for s in open_), 0.0
        for s in list(open_):
            out[s] += level * w[s]
        for s in list(open_):
            if out[s] >= limit * sizes[s]:
                more += out[s] - limit * sizes[s]
                out[s] = limit * sizes[s]
                open_.discard(s)
        left = more
    return out


@pytest.mark.parametrize("bins", [2, 512])
def test_against_rule(spark, bins):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    rows = mixing.mix_sources(docs, labels, bins=bins).collect()
    assert len(rows) == docs.count()
    size, taken, words = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        words[r.source] = max(words[r.source], r.size)
        assert r.taken in (0, r.size, 2 * r.size) and r.taken == r.size * r.repeats
    want = targets(size)
    for r in rows:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9) and r.source_size == size[r.source]
    for s in size:
        assert abs(taken[s] - want[s]) <= words[s]
    again = mixing.mix_sources(docs.repartition(7), labels, bins=bins)
    assert sorted((r.doc_id, r.taken) for r in again.collect()) == sorted((r.doc_id, r.taken) for r in rows)
    assert sorted((r.doc_id, r.taken) for r in mixing.mix_figures(docs, labels, bins=3).collect()) == sorted((r.doc_id, r.taken) for r in rows)
    assert mixing.repeat_rows(mixing.mix_sources(docs, labels)).count() == sum(r.repeats for r in rows)


def test_quality_weights_favour_good_rows(spark, make_docs):
    docs = make_docs([(k, "w w", "ab"[k % 2]) for k in range(2_000)] + [(10_000 + k, "w " * 40, "c") for k in range(300)])
    labels = spark.createDataFrame([(k, int(k % 4 < 2), 0) for k in range(2_000)], NO_LABELS)
    rows = [r for r in mixing.mix_sources(docs, labels, share=0.5).collect() if r.source == "b" and r.doc_id < 2_000]
    good, poor = (sum(r.taken for r in rows if (r.doc_id % 4 < 2) == f) for f in (True, False))
    assert rows[0].target < rows[0].source_size * 2
    if 0 < rows[0].target % rows[0].source_size:
        assert good > poor


def test_odd_rows(spark, make_docs):
    rows = [(1, None, "a"), (1, None, "a"), (2, "", None), (3, "x y z", None), (None, "x", "b"), (None, "x", "b"), (4, "w " * 5_000, "é"), (5, "only", "\U0001f600")]
    got = mixing.mix_sources(make_docs(rows), spark.createDataFrame([(3, None, 1), (4, 1, 0), (4, 0, 0)], NO_LABELS)).collect()
    assert len(got) == len(rows)
    assert {r.source_size for r in got if r.source is None} == {3} and all(r.taken <= 2 * r.size for r in got)
    assert all(r.taken == 0 and r.size == 0 for r in got if r.source == "a")
    assert mixing.mix_sources(make_docs([])).count() == 0


@pytest.mark.parametrize("clash", [False, True])
def test_null_and_repeated_ids_meet_their_targets(spark, make_docs, clash):
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"w{k} " + "w " * 9 if k < 3_000 else "ten words that are the same in all of them", "abc"[k % 3]) for k in range(6_000)]
    docs = make_docs(rows)
    if clash:  # names of the plan's own columns
        docs = docs.selectExpr("*", "1 as epochs", "2 as room", "3 as cut", "4 as n1", "5 as n2", "6 as __size", "7 as __key", "8 as __s", "9 as copies", "10 as __nth")
    for mixed in (mixing.mix_sources(docs, share=0.9), mixing.mix_figures(docs, share=0.9)):
        got = mixed.groupBy("source").agg({"taken": "sum", "target": "max", "*": "count"}).collect()
        assert len(got) == 3 and all(abs(r["sum(taken)"] - r["max(target)"]) <= 10 and r["count(1)"] == 2_000 for r in got), got
    assert mixing.repeat_rows(mixing.mix_sources(docs, share=0.9)).columns == docs.drop("size").columns
    same = make_docs([(None, "a b c d e f g h i j", "ab"[k % 2]) for k in range(1_000)])
    got = mixing.mix_sources(same, share=0.7).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 5 for r in got), got
