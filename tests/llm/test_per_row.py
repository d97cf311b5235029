"""Operators that judge rows by themselves: quality rules, token files, toxicity, chat formatting."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkvista.llm import chat, quality, token_store, toxicity
from sparkvista.llm.common import table

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (3, " \n\t ", "a"), (None, "a b a b a b a b", "b"), (5, "x y\n" * 3_000, "b"), (6, "é ñ  ö ß <|endoftext|> \x1f   z", "c"), (7, "one\x00two three\r\nfour", "c")]


def base_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    hit = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines, seen, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def test_quality_against_brute_force(spark, make_docs):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    odd = make_docs(ODD).select("doc_id", "text")
    for frame in (docs, odd):
        want = Counter((r.doc_id, *base_of(r.text)) for r in frame.collect())
        got = quality.quality_rules(frame).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
        assert all(not (r.base_failed and r.kept) for r in got)
    assert quality.quality_rules(odd.limit(0)).count() == 0


def test_quality_bands(spark, make_docs):
    rng = np.random.default_rng(1)
    noise = " ".join("".join(map(chr, rng.integers(0x4E00, 0x9FFF, 6))) for _ in range(400))
    clean = next(r.text for r in table(spark, SF, "documents").collect() if 100 < len(r.text.split()) < 300 and quality.in_band(len(r.text.encode()), 0.5, 0))
    # no window of three words repeats, but the text is one long run of a few letters
    dull = " ".join("a" * k + "b" * (400 - k) for k in range(1, 300))
    got = {r.doc_id: r for r in quality.quality_rules(make_docs([(1, noise, "a"), (2, clean, "a"), (3, dull, "a")])).collect()}
    assert not got[1].base_failed and not got[1].kept or got[1].ratio <= 0.9
    assert got[2].kept and not got[3].base_failed and not got[3].kept


def test_quality_reads_the_end_of_a_text(spark, make_docs):
    prose = max((r.text for r in table(spark, SF, "documents").collect() if quality.in_band(len(r.text.encode()), 0.5, 0)), key=len).encode()
    start, phrase = prose[: quality.CHUNK], b"the very same phrase again and again "
    rows = [(k, (start + tail).decode("utf-8", "ignore"), "a") for k, tail in enumerate((b"", phrase * 27, phrase * 35, b" x", prose[quality.CHUNK : 2 * quality.CHUNK - 40]))]
    got = {r.doc_id: r.bad_chunk_share for r in quality.quality_rules(make_docs(rows)).collect()}
    assert got == {0: 0, 1: 0.5, 2: 0.5, 3: 0, 4: 0}
    for n in (0, 1, 2_047, 2_048, 2_049, 2_111, 2_112, 4_095, 4_096, 5_000):
        raw = bytes(k % 251 for k in range(n))
        assert b"".join(quality.chunks_of(raw)) == (raw if n >= quality.CHUNK else b"")


def test_token_files_round_trip(spark, make_docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_store.default_tokenizer())
    for k, frame in enumerate((table(spark, SF, "documents"), make_docs(ODD))):
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, len(r.text or ""), r.text is not None, r.text or "") for r in frame.collect()))
        at, want = 0, []
        for has, doc_id, _, _, text in rows:
            ids = t.encode(text, add_special_tokens=False).ids + [0]
            want.append((doc_id if has else None, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        path = str(tmp_path / f"orc{k}")
        token_store.write_tokens(frame, path)
        got = [tuple(r) for r in token_store.token_digests(spark, path).collect()]
        assert sorted(got, key=lambda r: r[1:]) == want
        some = want[len(want) // 2]
        assert [r.n_tokens for r in token_store.lookup(spark, path, [some[0]]).collect()].count(some[2]) >= 1
    token_store.write_tokens(make_docs([]), str(tmp_path / "none"))
    assert token_store.token_digests(spark, str(tmp_path / "none")).count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    train, test = labels.filter("crc32(cast(doc_id as string)) % 3 > 0"), labels.filter("crc32(cast(doc_id as string)) % 3 = 0")
    got = toxicity.score_toxicity(docs, train, max_labelled=1_500).join(test, "doc_id").select("is_toxic", "toxic", "p_toxic").toPandas()
    assert len(got) > 500
    recall = got[got.toxic == 1].is_toxic.mean()
    false = got[got.toxic == 0].is_toxic.mean()
    assert recall > 0.9 and false < 0.02, (recall, false)


def test_toxicity_odd_rows(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(make_docs(ODD), none).collect()
    assert len(got) == len(ODD) and not any(r.is_toxic for r in got)
    marks = spark.createDataFrame([(1, None, 1), (1, 1, None), (99, 1, 1), (None, 0, 0), (2, 0, 0)], none.schema)
    assert toxicity.score_toxicity(make_docs(ODD), marks).count() == len(ODD)
    assert toxicity.score_toxicity(make_docs([]), marks).count() == 0


def test_columns_with_the_names_of_results(spark, make_docs):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    docs = make_docs(ODD).selectExpr("*", "'x' as is_toxic", "1 as p_toxic", "2 as at", "3 as fold", "4 as word")
    got = toxicity.score_toxicity(docs, labels, keep=tuple(docs.columns))
    assert got.columns == [c for c in docs.columns if c not in ("is_toxic", "p_toxic")] + [f"p_{c}" for c in toxicity.CATEGORIES] + ["is_toxic"]
    assert got.count() == len(ODD)
    clean = toxicity.without_toxic(docs, labels)
    assert clean.columns == docs.columns and clean.count() == got.filter("not is_toxic").count()


def test_chain_reads_earlier_probabilities():
    rng = np.random.default_rng(0)
    rows, a = [], rng.random(600) < 0.5
    for flag in a:
        rows.append({f"w{rng.integers(40)}", "sign" if flag else "none"})
    words = sorted(set().union(*rows))
    x = toxicity.presence(rows, {w: k for k, w in enumerate(words)})
    chain = toxicity.fit_chain(x, words, {"first": a.astype(float), "second": a.astype(float)}, np.arange(600) % 5, features=4)
    assert chain[1].earlier.shape == (1,) and chain[1].earlier[0] > 0
    assert ((toxicity.predict(chain, rows)[:, 1] > 0.5) == a).all()


def test_chain_against_plain_loops():
    """Out-of-fold predictions and their words come from the other folds: each fold fitted anew, word by word."""
    rng = np.random.default_rng(4)
    words, n = [f"w{k:02d}" for k in range(30)], 300
    x = (rng.random((n, 30)) < 0.3).astype(float)
    labels = {"a": ((x[:, 0] + x[:, 1] + rng.random(n)) > 1.2).astype(float), "b": ((x[:, 1] + x[:, 2] + rng.random(n)) > 1.4).astype(float)}
    folds = rng.integers(0, toxicity.FOLDS, n)

    def best(rows, y):
        def gain(k):
            yes, no = sum(x[i, k] for i in rows if y[i]), sum(x[i, k] for i in rows if not y[i])
            p, q = (yes + 0.5) / (sum(y[i] for i in rows) + 1), (no + 0.5) / (sum(1 - y[i] for i in rows) + 1)
            return (p - q) * np.log(p / q) + (p - q) * np.log((1 - q) / (1 - p))

        return sorted((k for k in range(30) if sum(x[i, k] for i in rows) >= 3), key=lambda k: (-round(gain(k), 12), k))[:5]

    earlier, chain = np.zeros((n, 0)), toxicity.fit_chain(x, words, labels, folds, features=5)
    for link, y in zip(chain, labels.values(), strict=True):
        top = best(range(n), y)
        w = toxicity.fit_logistic(np.hstack([x[:, top], earlier]), y)
        assert list(link.words) == [words[k] for k in top] and np.allclose(np.concatenate([link.weights, link.earlier, [link.bias]]), w)
        out = np.zeros(n)
        for f in range(toxicity.FOLDS):
            train, test = [i for i in range(n) if folds[i] != f], [i for i in range(n) if folds[i] == f]
            own = np.hstack([x[:, best(train, y)], earlier])
            out[test] = toxicity.sigmoid(np.hstack([own[test], np.ones((len(test), 1))]) @ toxicity.fit_logistic(own[train], y[train]))
        earlier = np.hstack([earlier, out[:, None]])


def test_telling_words_hold_those_of_every_fold(spark, monkeypatch):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    sample = toxicity.sample_texts(docs, labels, 500)
    found, rows = set(toxicity.telling_words(sample, 20)), sample.collect()
    every = sorted(set().union(*(toxicity.words_of(r.text) for r in rows)))
    x = toxicity.presence([toxicity.words_of(r.text) for r in rows], {w: k for k, w in enumerate(every)})
    want = set()
    for fold in range(-1, toxicity.FOLDS):
        train = np.array([r.fold != fold for r in rows])
        for c in toxicity.CATEGORIES:
            want |= {every[k] for k in toxicity.pick_words(x[train], np.array([r[c] for r in rows], float)[train], 20)}
    assert len(found ^ want) <= 0.02 * len(want)  # ties in floating point


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<s>\\ </s> [INST]"), (1, 2, "user", None), (1, 3, "assistant", ""),
    (2, 1, "assistant", "[\\INST] \\\\ <</SYS>>"), (2, 0, "system", "<<SYS>> [/TURN]"),
    (3, 0, None, "x"), (3, 0, "tool [/ROLE] <s>", "y\n\\"), (3, None, "user", "<"), (3, 0, "user", "z"), (3, 0, "user", "z"),
    (None, 0, "user", "["), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (4, 0, "user", "a\\" * 5_000),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(CHATS, "conv_id long, turn int, role string, text string").selectExpr("*", "1 as formatted", "'x' as segments")
    chats = chat.format_chats(rows)
    got = {r.conv_id: r for r in chat.chat_digests(chats).collect()}
    key = lambda x: (x is not None, x if x is not None else 0)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for conv in {c[0] for c in CHATS}:
        turns = sorted((c[1:] for c in CHATS if c[0] == conv), key=lambda t: (key(t[0]), (t[1] is not None, t[1] or ""), (t[2] is not None, t[2] or "")))
        r = got[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == sha("".join(f"{b or ''}\n{c or ''}\n" for _, b, c in turns)), conv
        loss = "".join(c or "" for _, b, c in turns if b == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert got[1].is_valid and got[-1].is_valid and not got[2].is_valid and got[2].bad_turn == 1
    assert not got[4].is_valid and got[4].bad_turn == 1
    text = {r.conv_id: r.formatted for r in chats.collect()}
    assert text[-1].count("</s>") == 1 and text[-1].count("[INST]") == 1
    assert chat.format_chats(rows.limit(0)).count() == 0


def test_chat_other_template(spark):
    plain = chat.Template(roles={"user": chat.Turn("<u>", "</u>", False), "assistant": chat.Turn("<a>", "</a>", True)}, follows={"": ("user",), "user": ("assistant",)})
    rows = spark.createDataFrame([(1, 0, "user", "<a>"), (1, 1, "assistant", "</u>\\")], "conv_id long, turn int, role string, text string")
    r = chat.format_chats(rows, plain).collect()[0]
    assert r.formatted == "<u><\\a></u><a><\\/u>\\\\</a>" and r.is_valid
    assert [s.text for s in r.segments if s.loss] == ["<\\/u>\\\\"]


@pytest.mark.parametrize("role,next_role,ok", [("user", "assistant", True), ("assistant", "user", False), ("system", "assistant", False)])
def test_chat_state_machine(spark, role, next_role, ok):
    rows = spark.createDataFrame([(1, 0, role, "a"), (1, 1, next_role, "b")], "conv_id long, turn int, role string, text string")
    assert chat.format_chats(rows).first().is_valid is ok


def test_null_ids_are_dealt_over_tasks(spark, tmp_path):
    """Three quarters of the rows without an id, half of all equal: no file has them all, and starts still add up."""
    rows = spark.range(4_000).selectExpr("if(id < 3000, null, id) doc_id", "if(id < 2000, 'the same', concat('text ', id)) text").repartition(5)
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    token_store.write_tokens(rows, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in token_store.read_tokens(spark, path).selectExpr("_metadata.file_name f").groupBy("f").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 2_000
    got = sorted((r.start, r.n_tokens) for r in token_store.token_digests(spark, path).collect())
    assert len(got) == 4_000 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:]))


def test_a_null_quality_counts_as_good(spark, make_docs):
    labels = spark.createDataFrame([(1, None, 1), (2, 0, 0), (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.sample_texts(make_docs([(k, f"text {k}", "a") for k in (1, 2, 3, None)]), labels, 10).collect()
    assert sorted(r.text for r in found) == ["text 1", "text 2"]
