"""Byte-level BPE against the tiktoken library, and the laws of its tree reduction."""

import base64
import hashlib
from collections import Counter
from functools import reduce

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkvista.llm import byte_bpe
from sparkvista.llm.common import table
from sparkvista.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (3, " \n\t ", "a"), (None, "it's we'll  <|endoftext|> \x00 x퟿", "b"), (5, "!" * 9_000 + "ab" * 3_000, "b"), (6, "é ñ  ö ß 漢字かな 🙂👍🏽 \x1f   z", "c")]


@pytest.fixture(scope="module")
def library():
    with open(byte_bpe.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec(byte_bpe.default_ranks(), byte_bpe.default_pattern())


def ids_of(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


def test_against_the_library(spark, make_docs, library):
    for frame in (table(spark, SF, "documents"), make_docs(ODD)):
        want = Counter()
        for r in frame.collect():
            ids = library.encode_ordinary(r.text or "")
            want[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
        assert Counter(map(tuple, byte_bpe.bpe_digests(frame).collect())) == want
    assert byte_bpe.bpe_digests(make_docs(ODD).limit(0)).count() == 0
    assert QUERIES["op11_byte_bpe"](spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("ab", max_size=200), st.text(" \n'slvred", max_size=60), st.text("0aé漢", max_size=120)))
def test_any_text(library, codec, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = ids_of(codec, text)
    assert ids == library.encode_ordinary(text) and codec.decode(np.array(ids, "<u4")) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), min_size=2, max_size=6))
def test_joining_is_associative(codec, parts):
    trees = [codec.tree(p) for p in parts]
    whole = codec.tree(b"".join(parts))
    assert reduce(codec.join, trees) == whole == reduce(lambda right, left: codec.join(left, right), reversed(trees))
    assert whole == byte_bpe.merged({b: i for i, b in enumerate(codec.bytes_of) if b}, b"".join(parts))


def test_pieces_without_end(library, codec):
    rng = np.random.default_rng(3)
    for text in ("a" * 20_000, "0123456789" * 2_000, "".join(map(chr, rng.integers(97, 101, 20_000))), "漢" * 5_000, " " * 3_000):
        assert ids_of(codec, text) == library.encode_ordinary(text)


def test_long_texts_are_streamed(library, codec, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 100)
    text = "Some words, and  more:\n\n" * 400
    assert ids_of(codec, text) == library.encode_ordinary(text)


def test_kept_columns(spark, make_docs):
    docs = make_docs(ODD).withColumnRenamed("size", "ids").withColumnRenamed("source", "odd.name")
    coded = byte_bpe.encode_texts(docs, ["doc_id", "ids", "odd.name", "lang"])
    assert coded.columns == ["doc_id", "odd.name", "lang", "n_tokens", "ids"] and coded.count() == len(ODD)
    back = byte_bpe.decode_ids(coded, ["doc_id", "n_tokens"]).collect()
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back) == Counter((i, (t or "").encode()) for i, t, _ in ODD)


def test_bytes_that_are_not_utf8(spark, library):
    rows = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert bytes(byte_bpe.decode_ids(byte_bpe.encode_texts(rows, ["doc_id"]), ["doc_id"]).first().decoded).decode() == "a�b"
