import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sparkvista.llm import column_bwt, suffix_dedup
from sparkvista.llm.common import table


def brute(rows, window=400):
    seen = Counter()
    for _, text in rows:
        raw = (text or "").encode()
        seen.update(raw[k : k + window] for k in range(len(raw) - window + 1))
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - window + 1):
            if seen[raw[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc_id, len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def result(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame).collect()), key=str)


@pytest.mark.parametrize("hot", [4_096, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark, make_docs):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmno é", k=1000))
    a, b, c = word(), word(), word()
    rows = [(1, None), (2, ""), (3, "x" * 2_000), (4, a + "|" + b), (5, b + a), (5, b + a), (None, c), (7, c[:398] + "é" + c[300:]), (8, a[10:420]), (9, "ab" * 700), (10, c + "-" + c), (11, a[:399]), (12, word() + b[100:550] + word())]
    assert result(make_docs([(i, t, "s") for i, t in rows])) == brute(rows)
    assert result(make_docs([])) == []
    kept = {r.doc_id: r.kept for r in suffix_dedup.remove_repeats(make_docs([(1, a, "s"), (2, a, "s"), (3, b, None)]), texts=True).collect()}
    assert kept == {1: b"", 2: b"", 3: b.encode()}


def test_long_text_in_parts(spark, make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PART", 3_000)
    rng = random.Random(6)
    a = "".join(rng.choices("abcdef", k=20_000))
    rows = [(1, a + a[5_000:6_500]), (2, "z" + a[2_500:3_500] + "z"), (3, a[:500])]
    assert result(make_docs([(i, t, "s") for i, t in rows])) == brute(rows)


@pytest.mark.parametrize("seed", range(6))
def test_construction(seed):
    rng = random.Random(seed)
    docs = [[rng.randrange(1, 2 + seed * 60) for _ in range(rng.randrange(12))] for _ in range(25)]
    docs += docs[:5]
    starts = np.cumsum([0] + [len(d) for d in docs])
    symbol, prefix, string, length = column_bwt.build(np.array([c for d in docs for c in d], np.uint16), starts)
    suffixes = [docs[s][len(docs[s]) - n :] for s, n in zip(string.tolist(), length.tolist(), strict=True)]
    assert suffixes == sorted(d[k:] for d in docs for k in range(len(d) + 1))
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: E731, B905
    assert prefix.tolist() == [0] + [common(a, b) for a, b in zip(suffixes, suffixes[1:], strict=False)]
    assert all(c == (docs[s][-n - 1] if n < len(docs[s]) else column_bwt.END) for c, s, n in zip(symbol.tolist(), string.tolist(), length.tolist(), strict=True))


def test_range_minima():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1000, 9_000).astype(np.uint16)
    a = rng.integers(0, 9_000, 300)
    b = np.minimum(8_999, a + rng.integers(0, 6_000, 300))
    assert (column_bwt.range_minima(values, a, b) == [values[x : y + 1].min() for x, y in zip(a, b, strict=True)]).all()
