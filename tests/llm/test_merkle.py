"""The Merkle manifest against a plain walk over sorted leaves."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from sparkvista.llm import common, merkle
from sparkvista.llm.common import table

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(r, text):
    parts = [r.doc_id, r.source, r.lang, r.n_chars, text]
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in parts))


def walk(nodes):
    """The root, and for each node the siblings (left, right) of each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            first = i - i % 8
            paths[k].append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 8])))
        nodes, at = [sha("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)], [i // 8 for i in at]
    return nodes[0], paths


def brute(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r.lang].append((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    done = {n: walk([x[2] for x in sorted(trees[n], key=lambda x: x[:3])]) for n in names}
    root, upper = walk([done[n][0] for n in names])
    out = []
    for n, above in zip(names, upper):
        for (_, _, leaf, r), own in zip(sorted(trees[n], key=lambda x: x[:3]), done[n][1]):
            path, node = own + above, leaf
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None:
                node = leaf_of(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text))
            for left, right in path:
                node = sha(left + node + right)
            out.append((r.doc_id, leaf, done[n][0], root, sha("".join(a + b for a, b in path)), node, node == root))
    return out


def test_against_a_plain_walk(spark):
    docs = table(spark, SF, "documents")
    got = [tuple(r) for r in merkle.merkle_digests(docs).collect()]
    assert Counter(got) == Counter(brute(docs.collect())) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 9, 64, 513, 1_100])
def test_sizes(spark, n):
    rows = spark.range(n).selectExpr("id AS doc_id", "'S' AS source", "if(id % 100 = 99, null, 'en') AS lang", "id AS n_chars", "concat('Text ', id) AS text", "'x' AS leaf", "'y' AS root")
    assert Counter(map(tuple, merkle.merkle_digests(rows).collect())) == Counter(brute(rows.collect()))


def test_odd_rows(spark, make_docs):
    odd = [(1, None, "a"), (1, "", None), (3, "ÀB\n", "a"), (3, "ÀB\n", "a"), (None, "A", "b"), (None, "A", "b"), (None, None, None), (-7, "Z" * 50_000, "c")]
    docs = make_docs(odd)
    assert Counter(map(tuple, merkle.merkle_digests(docs).collect())) == Counter(brute(docs.collect()))
    assert merkle.merkle_digests(docs.limit(0)).count() == 0


def test_many_trees(spark):
    rows = spark.range(700).selectExpr("id AS doc_id", "'S' AS source", "concat('l', id % 600) AS lang", "id AS n_chars", "'T' AS text")
    assert Counter(map(tuple, merkle.merkle_digests(rows).collect())) == Counter(brute(rows.collect()))


def test_ranks_of_a_hot_group(spark):
    """Equal rows and one large group are dealt over tasks, and still numbered without gaps."""
    rows = common.materialize(spark.range(4_000).selectExpr("if(id < 3000, 'hot', concat('g', id % 50)) AS g", "if(id < 2000, null, id) AS v"), "rows")
    got = common.ranked(rows, ["g"], ["v"])
    groups = defaultdict(list)
    for r in got.collect():
        groups[r.g].append((r.place, r.v, r.total))
    for found in groups.values():
        found.sort()
        assert [p for p, _, _ in found] == list(range(len(found))) and {t for _, _, t in found} == {len(found)}
        assert [v for _, v, _ in found] == sorted([v for _, v, _ in found], key=lambda v: (v is not None, v or 0))
    assert sum(map(len, groups.values())) == 4_000
