import random
import re
from collections import defaultdict

import numpy as np
import pytest

from sparkvista.llm import ngram_join
from sparkvista.llm.common import table
from sparkvista.llm.hashing import components


def grams(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, limit=0.8):
    """(doc_id, text) -> links and the least id of each row's group."""
    sets = [grams(t) for _, t in rows]
    near = defaultdict(set)
    holders = defaultdict(set)
    for k, s in enumerate(sets):
        for g in s:
            holders[g].add(k)
    for a, s in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for b in holders[g]:
                common[b] += 1
        near[a] = {b for b, c in common.items() if b != a and 5 * c >= 4 * (len(s) + len(sets[b]) - c)}
    group = list(range(len(rows)))
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        group[a] = min(ids) if ids else None
    return sorted(((r[0], group[k], len(near[k])) for k, r in enumerate(rows)), key=str)


def result(frame):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_links(frame).collect()), key=str)


@pytest.mark.parametrize("blocks", [(1_024, 256), (3, 2)])
def test_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", blocks[0])
    monkeypatch.setattr(ngram_join, "FAMILY_BLOCK", blocks[1])
    docs = table(spark, "/root/testdata/sf0.01" if blocks[0] > 3 else "/root/testdata/sf0.001", "documents")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def near_copies(count, words=120, edits=2, seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        yield " ".join(w)


def test_large_family_in_blocks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 40)
    monkeypatch.setattr(ngram_join, "FAMILY_BLOCK", 30)
    rows = [(k, t, "a") for k, t in enumerate(near_copies(150))]
    assert result(make_docs(rows)) == brute([r[:2] for r in rows])


def test_odd_rows(spark, make_docs):
    long = " ".join(f"v{k}" for k in range(30_000))
    rows = [(1, None, "a"), (1, None, "a"), (2, "", "a"), (3, "  \n", "b"), (4, "one two", "b"), (5, "one\ttwo", "b"), (5, "one\ttwo", "b"), (None, "one two", "c"), (None, "a b c d e f", "c"), (None, "a b c d e f", "c"), (7, long, "c"), (8, long + " end", "c")]
    assert result(make_docs(rows)) == brute([r[:2] for r in rows])
    docs = make_docs(rows).selectExpr("*", "1 as cls", "2 as id", "3 as doc", "4 as __id", "5 as root")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    kept = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert kept == sorted([(1, None), (1, None), (2, ""), (3, "  \n"), (4, "one two"), (None, "a b c d e f"), (7, long)], key=str)
    assert ngram_join.ngram_links(make_docs([])).count() == 0 and ngram_join.keep_one(make_docs([])).count() == 0


def test_keep_one_of_each_group_without_distinct_ids(spark, make_docs):
    first, second, third, fourth = (list(near_copies(4, edits=1, seed=seed)) for seed in (11, 12, 13, 14))
    rows = [(None, t, "a") for t in first + second] + [(1, third[0], "a"), (2, third[1], "a"), (3, third[2], "a"), (1, fourth[0], "a"), (4, fourth[1], "a")]
    kept = [(r.doc_id, r.text) for r in ngram_join.keep_one(make_docs(rows)).collect()]
    assert [sum(t in group for _, t in kept) for group in (first, second, third, fourth)] == [1, 1, 1, 1]
    assert {(1, third[0]), (1, fourth[0])} <= set(kept)


def test_bands_meet_the_recall():
    for t in (0.5, 0.8, 0.9):
        b, r = ngram_join.bands_for(t, 0.999, 128)
        assert b * r <= 128 and 1 - (1 - t**r) ** b >= 0.999


def test_edges_grow_with_the_group_not_its_square(spark, make_docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 100)
    monkeypatch.setattr(ngram_join, "FAMILY_BLOCK", 100)
    counts, whole = [], ngram_join.connected

    def counted(edges):
        counts[-1].append(edges.distinct().count())
        return whole(edges)

    monkeypatch.setattr(ngram_join, "connected", counted)
    for m in (400, 1_200):
        counts.append([])
        rows = [(k, t, "a") for k, t in enumerate(near_copies(m, words=60, edits=1))]
        assert {r.class_id for r in ngram_join.ngram_links(make_docs(rows)).collect()} == {0}
    assert all(b <= 3.7 * a for a, b in zip(*counts, strict=True)), counts  # thrice the members


def test_families_are_chains_of_near_sketches():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, (3, 40)).astype(np.uint8)
    rows = np.concatenate([np.repeat(x[None], 15, 0) for x in base])
    for r in rows:
        r[rng.integers(0, 40, 9)] = rng.integers(0, 256, 9)
    rows = rows[rng.permutation(len(rows))]
    near = (rows[:, None] == rows[None]).sum(2) >= 24
    i, j = np.nonzero(near)
    assert (ngram_join.families(rows, 24) == components(len(rows), i, j)).all()
    assert len(ngram_join.families(rows[:0], 24)) == 0
