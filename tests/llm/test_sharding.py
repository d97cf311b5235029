from collections import Counter

import pytest

from sparkvista.llm import sharding
from sparkvista.llm.common import table

ROWS = [(1, None, "a"), (1, None, "a"), (2, "", None), (None, "x", "b"), (None, "x", "b"), (4, "w " * 50_000, "é"), *((k, f"text {k}", "c") for k in range(10, 60))]


def test_round_trip(spark, make_docs, tmp_path):
    docs = make_docs(ROWS).selectExpr("*", "1 as shard_no", "'v' as version")
    store = sharding.shard_arrivals(docs, str(tmp_path / "s"), target=6_000, small=1_500)
    assert Counter(map(tuple, store.read().collect())) == Counter(map(tuple, docs.collect()))
    rows = store.read_with_shards().collect()
    assert len(rows) == len(ROWS) and {r.version for r in rows} == {store.version()}
    assert Counter(r.shard_no for r in rows) == {r.shard_no: r.shard_rows for r in rows}
    assert not sharding.merge_groups(store.manifest().shards, 6_000, 4, 1_500)
    empty = sharding.shard_arrivals(make_docs([]), str(tmp_path / "e"))
    assert empty.read().columns == make_docs([]).columns and empty.read().count() == empty.read_with_shards().count() == 0


def test_target_size(spark, tmp_path):
    docs = table(spark, "/root/testdata/sf0.01", "documents").repartition(40)
    store = sharding.shard_arrivals(docs, str(tmp_path / "s"), arrivals=2, target=300_000, small=60_000)
    sizes = [s.bytes for s in store.manifest().shards]
    assert store.read().count() == 1_000 and sum(b >= 150_000 for b in sizes) >= 2 and max(sizes) <= 400_000


def test_versions_and_conflicts(spark, make_docs, tmp_path):
    store, other = (sharding.ShardStore(spark, str(tmp_path / "s"), fanout=2) for _ in range(2))
    assert store.version() == 0 and store.manifest().shards == ()
    store.append(make_docs(ROWS[:3]).coalesce(1))
    stale = other.manifest()
    store.append(make_docs(ROWS[3:]).coalesce(1))
    with pytest.raises(sharding.CommitConflict):
        other._commit(stale, stale.schema, stale.shards)
    assert store.compact().version == 3 and len(store.manifest().shards) == 1
    assert store.read(1).count() == 3 and store.read(2).count() == len(ROWS)
    assert store.compact().version == 3
    assert store.vacuum() == 2 and store.read().count() == len(ROWS)


def test_vacuum_spares_an_append_that_is_not_committed_yet(spark, make_docs, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), fanout=2)
    store.append(make_docs(ROWS[:3]).coalesce(1))
    store.append(make_docs(ROWS[3:5]).coalesce(1))
    late = make_docs(ROWS[5:])
    staged = store.stage(late)[0]
    store.compact()
    assert store.vacuum(keep=2) == 0 and store.read(2).count() == 5
    assert store.vacuum() == 2  # the two that the merge has replaced
    store.add(staged, late.schema)
    assert Counter(map(tuple, store.read().collect())) == Counter(map(tuple, make_docs(ROWS).collect()))
    lost = store.stage(late)[0]
    assert store.vacuum() == 0 and store.vacuum(grace_s=-1) == len(lost) and store.read().count() == len(ROWS)


def test_writers_that_meet_both_commit(spark, make_docs, tmp_path, monkeypatch):
    one, other = (sharding.ShardStore(spark, str(tmp_path / "s"), fanout=2) for _ in range(2))
    docs, commit, rivals = make_docs(ROWS[:4]).coalesce(1), sharding.ShardStore._commit, []

    def slow(self, *args):
        if self is one and rivals:
            rivals.pop()()
        return commit(self, *args)

    monkeypatch.setattr(sharding.ShardStore, "_commit", slow)
    rivals.append(lambda: other.append(docs))
    assert one.append(docs).version == 2 and one.read().count() == 8
    rivals.append(lambda: other.append(docs))  # an append while shards are merged
    assert one.compact().version == 4 and one.read().count() == 12 and len(one.manifest().shards) == 2
    rivals.append(lambda: other.compact())  # the same merge
    assert one.compact().version == 5 and one.read().count() == 12 and len(one.manifest().shards) == 1
    assert len([p for p in (tmp_path / "s" / "data").iterdir()]) == 5  # three appends, and a merge for each of two commits


def test_one_scan_and_one_task_for_each_group(spark, make_docs, tmp_path):
    docs = make_docs([(k, f"text {k} " * 50, "a") for k in range(400)]).repartition(8)
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target=12_000, small=2_000)
    store.add([s for part in store.stage(docs, docs["doc_id"].cast("int") % 3).values() for s in part], docs.schema)
    groups = sharding.merge_groups(store.manifest().shards, 12_000, 4, 2_000)
    assert len(groups) > 3
    left = len(store.manifest().shards) - sum(map(len, groups))
    assert len(store.compact().shards) == left + len(groups) and store.read().count() == 400


def test_merge_groups():
    s = lambda n, b: sharding.Shard(f"s{n}", 1, b)
    small = [s(k, 10) for k in range(9)]
    groups = sharding.merge_groups([*small, s(9, 95), s(10, 40)], target=50, fanout=4, small=20)
    assert [len(g) for g in groups] == [5, 4] and all(x.bytes == 10 for g in groups for x in g)
    assert sharding.merge_groups(small[:3], 50, 4, 20) == []
