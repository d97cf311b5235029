import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from sparkvista.llm import lm_scoring as lm
from sparkvista.llm.common import table
from sparkvista.llm import attention
from sparkvista.llm.token_store import default_tokenizer

LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def base(rows):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, words in split if not held(i) for w in words)
    n, v = sum(c.values()), len(c)
    return sorted(((i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)) for i, w in split), key=str)


def scored(frame, **options):
    rows = lm.score_texts(frame, **options).collect()
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows), key=str), rows


def test_base_and_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    rows = lm.score_texts(docs, head=3_000).collect()
    # held-out texts are better told by attention than by counts of words, although these give unknown words too much
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    assert scored(docs, head=3_000)[0] == base([(r.doc_id, r.text) for r in docs.collect()])


def test_layout_does_not_change_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 500)
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    one, other = ({r.doc_id: r.score for r in lm.score_texts(docs.repartition(n)).collect()} for n in (2, 16))
    assert max(abs(one[k] - other[k]) / abs(one[k]) for k in one) < 1e-5


def test_odd_rows(spark, make_docs):
    rows = [(1, None, "a"), (1, None, "a"), (2, "", "a"), (None, "x Y z", "b"), (3, "A a. a, . ,   <|endoftext|> \x1f", "b"), (4, "long " * 20_000, "c"), (5, "Ä ä don't", None)]
    assert scored(make_docs(rows))[0] == base([r[:2] for r in rows])
    assert scored(make_docs(rows), head=1)[0] == base([r[:2] for r in rows])
    assert scored(make_docs([(None, "only held out", "a")]))[0] == base([(None, "only held out")])
    assert lm.score_texts(make_docs([])).count() == 0


def test_every_training_row_makes_counts_and_trains(spark):
    texts = [f"alpha beta w{k} " + "gamma " * 90 * (k % 3) for k in range(30)]
    coder = lm.encoder(default_tokenizer())
    end = coder.tokenizer.get_vocab_size()
    ids, ends = coder.encode(pa.array(texts), end)
    frame = spark.createDataFrame([(k * 77 - 5, bytearray(ids[a:b].astype(lm.id_kind(end)).tobytes())) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:]))], "salt long, ids binary")
    got = lm._fill(frame.select("ids").mapInArrow(lm._id_counts(end), "id int, n long"), end + 1)
    assert (got == np.bincount(ids, minlength=end + 1)).all() and got[end] == 30
    rank = lm.ranks_of(got)
    cells = lm._fill(frame.select("ids").mapInArrow(lm._neighbours(rank), "id int, n long"), lm.OWN * (lm.BESIDE + lm.NEAR)).reshape(lm.OWN, -1)
    near = lambda low, high, most: sum(1 for a, b in zip(ends[:-1], ends[1:]) for k in range(a, b) for g in range(low, high) if k - g >= a and rank[ids[k - g]] < most)  # noqa: E731, B905
    assert cells[:, : lm.BESIDE].sum() == near(1, 2, lm.BESIDE) and cells[:, lm.BESIDE :].sum() == near(2, lm.REACH + 1, lm.NEAR)
    pieces = frame.mapInArrow(lm._training_pieces(end), "at long, later boolean, ids binary")
    count, windows_at = lm.piece_windows(pieces.toArrow(), end)
    said = windows_at(slice(0, count))[:, attention.CONTEXT + 1 :]
    windows = sum(-(-(b - a) // attention.STRIDE) for a, b in zip(ends[:-1], ends[1:], strict=True))
    assert len(said) == windows and sorted(said[said >= 0].tolist()) == sorted(ids.tolist())
    vocabulary = lm.vocabulary_of(got, cells.ravel())
    assert not np.allclose(lm.train(pieces, windows, vocabulary), lm.Network(vocabulary.embedding).flat())


def test_pieces_have_the_windows_of_their_text(monkeypatch):
    monkeypatch.setattr(lm, "PIECE", 2)
    rng = np.random.default_rng(2)
    ends = np.concatenate([[0], np.cumsum([1, 48, 49, 500, 24])])
    ids, end = rng.integers(0, 50, ends[-1]), 99
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(5)), pa.array([ids[a:b].astype("<u2").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["salt", "ids"])
    found = pa.Table.from_batches(lm._training_pieces(end)([batch]))
    count, windows_at = lm.piece_windows(found, end)
    got = np.concatenate([windows_at(slice(k, k + 5)) for k in range(0, count, 5)])
    want = attention.window_ids(ids, ends, end, *attention.window_places(ends))
    assert found.num_rows == 1 + 1 + 2 + 11 + 1 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_a_shard_of_equal_rows_is_read_in_parts(monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 100)
    batches = [pa.RecordBatch.from_pydict({"shard": s, "ids": [b"x" * 480] * len(s)}) for s in ([0] * 30, [0] * 5 + [1] * 3, [1] * 70, [2])]
    sizes = [t.num_rows for t in lm.shards_of(iter(batches), 2)]
    assert sizes == [19, 16, 19, 19, 19, 16, 1] and all(len(t.column("shard").unique()) == 1 for t in lm.shards_of(iter(batches), 2))


def test_texts_without_blanks(spark, make_docs):
    """Long words stay out of what is broadcast, and are still counted."""
    rows = [(k, "漢字" * 3_000 + chr(0x4E00 + k % 7), "a") for k in range(40)] + [(100 + k, "short words here", "b") for k in range(5)]
    assert scored(make_docs(rows))[0] == base([r[:2] for r in rows])
    counts = spark.createDataFrame([("x" * k, 5) for k in (1, 64, 65, 9_000)], "word string, c long")
    assert lm.commonest(counts.filter(f"octet_length(word) <= {lm.HEAD_BYTES}"), "c", 10).count() == 2


def vocabulary():
    counts = np.zeros(50_258, np.int64)
    counts[[10, 11, 12, 13, 50_257]] = 40, 30, 20, 6, 5
    cells = np.random.default_rng(0).integers(0, 9, (lm.OWN, lm.BESIDE + lm.NEAR))
    return lm.vocabulary_of(counts, cells)


def test_windows_predict_each_id_once():
    rng = np.random.default_rng(0)
    length = np.array([1, 6, 31, 32, 33, 100, 1])
    ends = np.concatenate([[0], np.cumsum(length)])
    ids = rng.integers(0, 50, ends[-1])
    text, nth = attention.window_places(ends)
    seen = attention.window_ids(ids, ends, 99, text, nth)
    said = seen[:, attention.CONTEXT + 1 :]
    assert (said[said >= 0] == ids).all() and (np.bincount(text, (said >= 0).sum(1)) == length).all()
    for t, n, x in zip(text, nth, seen, strict=True):
        before = [-1] * 60 + [99] + ids[ends[t] : ends[t + 1]].tolist() + [-1] * 60
        at = 60 + n * attention.STRIDE - attention.CONTEXT
        assert x.tolist() == before[at : at + len(x)]


def test_rare_ids_have_classes_by_their_counts():
    counts = np.zeros(50_258, np.int64)
    counts[:20_000] = np.arange(20_000, 0, -1)
    group = lm.vocabulary_of(counts, np.ones(lm.OWN * (lm.BESIDE + lm.NEAR), np.int64)).group
    share = np.bincount(group[lm.OWN :], counts[lm.OWN :], attention.CLASSES)[-attention.TAILS :]
    assert group[: lm.OWN].max() < attention.CLASSES - attention.TAILS and share.min() > 0.8 * share.max()


def test_probabilities_of_all_ids_sum_to_one():
    v, rng = vocabulary(), np.random.default_rng(1)
    share = np.bincount(v.group, 10 ** v.log_share(), attention.CLASSES)
    assert np.allclose(share[share > 0], 1) and share[v.group].all()
    net = attention.Network(v.embedding, 3)
    ids = v.inputs()[rng.integers(0, 50_258, (3, attention.CONTEXT + attention.STRIDE))]
    every = np.stack([net.log_classes(ids, np.full((3, attention.STRIDE), c)) for c in range(attention.CLASSES)], -1)
    assert np.allclose((10.0**every).sum(-1), 1, atol=1e-4)
    # all ids, one by one, at one place
    assert math.isclose((10 ** (every[0, 7].astype(float)[v.group] + v.log_share())).sum(), 10.0 ** every[0, 7].astype(float)[np.unique(v.group)] @ np.ones(len(np.unique(v.group))), rel_tol=1e-6)


def test_attention_is_causal_and_slopes_are_right():
    rng = np.random.default_rng(1)
    net, n, late = attention.Network(seed=3), attention.CONTEXT + attention.STRIDE, attention.CONTEXT
    ids = rng.integers(0, 50, (2, n))
    ids[0, :5] = -1
    target = rng.integers(0, attention.CLASSES, (2, attention.STRIDE))
    y = net.log_classes(ids, target)
    other = ids.copy()
    other[:, 30:] = 7
    assert np.allclose(y[:, : 30 - late], net.log_classes(other, target)[:, : 30 - late], atol=1e-5)
    other = ids.copy()
    other[:, 10] = 7
    assert not np.allclose(y, net.log_classes(other, target), atol=1e-5)
    target[1, 4] = -1
    net.w = {k: x.astype(np.float64) for k, x in net.w.items()}
    _, slopes = net.slopes(ids, target)
    for name, at in (("e", (int(ids[1, 3]), 2)), ("q", (1, 2)), ("k", (3, 4)), ("v", (0, 1)), ("o", (2, 3)), ("x", (1, 1)), ("c", (4, 5)), ("r", (2,)), ("b", (3,)), ("s", (1,))):
        kept, out = net.w[name][at], []
        for step in (1e-5, -1e-5):
            net.w[name][at] = kept + step
            out.append(net.slopes(ids, target)[0])
        net.w[name][at] = kept
        assert math.isclose((out[0] - out[1]) / 2e-5, slopes[name][at], rel_tol=2e-2, abs_tol=2e-5), name


def test_tables_give_what_each_place_gives():
    rng = np.random.default_rng(4)
    net = attention.Network(seed=3)
    ids = rng.integers(0, 4_000, (5, attention.CONTEXT + attention.STRIDE))
    ids[0, :5], ids[1, 20:] = -1, -1
    target = rng.integers(0, attention.CLASSES, (5, attention.STRIDE))
    zx = net.forward(ids)["zx"]
    y = np.clip(zx @ np.vstack([net.w["o"], net.w["x"], net.w["b"]]), -1, 1) @ net.w["c"] + net.w["s"]
    want = (y - np.log(np.exp(y).sum(1, keepdims=True)))[np.arange(len(y)), target.ravel()].reshape(target.shape) / math.log(10)
    said = ids[:, attention.CONTEXT :] >= 0
    for got in (net.log_classes(ids, target), net.log_classes(ids, target, net.tables())):
        assert np.allclose(got[said], want[said], atol=1e-5)
