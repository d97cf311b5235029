"""Byte-level BPE by ranks: encoding as a tree reduction of halves, and decoding.

A piece is cut into halves down to single bytes, and the tokens of neighbours are joined up the tree. A row of
tokens is the encoding of its bytes if, and only if, every two neighbours are the encoding of their own bytes:
merges go by rank, the leftmost first, so the first merge across a border would also happen in the two tokens
by themselves. A join therefore encodes a window over the border anew and widens it until the tokens beside
the window agree with it; all others stay as they are. This makes joining associative.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a worker remembers: pieces, parts of pieces and windows, each of at most PART bytes.
PIECES, PARTS, PART = 1 << 18, 1 << 16, 32
#: Characters from which a text's pieces are taken one by one, so that they are never all in memory.
LONG_TEXT = 1 << 20
#: Ids that a leaf of decoding joins.
LEAF_IDS = 4_096
_NONE = 1 << 62


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def merged(ranks: dict[bytes, int], raw: bytes) -> tuple[int, ...]:
    """The tokens of a window: of all neighbours whose bytes together are a token, those of least rank merge, the leftmost first."""
    if len(raw) <= PART:
        parts = [raw[k : k + 1] for k in range(len(raw))]
        rank = [ranks.get(raw[k : k + 2], _NONE) for k in range(len(raw) - 1)]
        while rank and (least := min(rank)) < _NONE:
            k = rank.index(least)
            parts[k] += parts.pop(k + 1)
            del rank[k]
            if k:
                rank[k - 1] = ranks.get(parts[k - 1] + parts[k], _NONE)
            if k < len(rank):
                rank[k] = ranks.get(parts[k] + parts[k + 1], _NONE)
        return tuple([ranks[p] for p in parts])
    end, before = list(range(1, len(raw) + 1)), list(range(-1, len(raw) - 1))  # of the part that begins at k
    heap = [(r, k, 2) for k in range(len(raw) - 1) if (r := ranks.get(raw[k : k + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * len(raw)
    while heap:
        _, k, size = heapq.heappop(heap)
        if not alive[k] or end[k] == len(raw) or end[end[k]] - k != size:
            continue  # one of its parts has changed since
        alive[end[k]] = False
        end[k] = k + size
        if end[k] < len(raw):
            before[end[k]] = k
        for at in (before[k], k):
            if at >= 0 and end[at] < len(raw) and (r := ranks.get(raw[at : end[end[at]]])) is not None:
                heapq.heappush(heap, (r, at, end[end[at]] - at))
    return tuple([ranks[raw[k : end[k]]] for k in range(len(raw)) if alive[k]])


class ByteBpe:
    """Encodes texts by a file of ranks, each match of a pattern by itself, and decodes ids."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.bytes_of[i] = raw
        self.find = regex.compile(pattern)
        bytes_of = self.bytes_of

        @lru_cache(PARTS)
        def short_window(raw: bytes) -> tuple[int, ...]:
            return merged(ranks, raw)

        def window(raw: bytes) -> tuple[int, ...]:
            return short_window(raw) if len(raw) <= PART else merged(ranks, raw)

        @lru_cache(PARTS)
        def agree(a: int, b: int) -> bool:
            return window(bytes_of[a] + bytes_of[b]) == (a, b)

        def join(left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
            if agree(left[-1], right[0]):
                return left + right
            mid, i, j = window(bytes_of[left[-1]] + bytes_of[right[0]]), 1, 1
            while True:
                more_left = i < len(left) and not agree(left[-i - 1], mid[0])
                more_right = j < len(right) and not agree(mid[-1], right[j])
                if not more_left and not more_right:
                    return left[: len(left) - i] + mid + right[j:]
                i, j = min(len(left), i * (1 + more_left)), min(len(right), j * (1 + more_right))
                mid = window(b"".join([bytes_of[t] for t in left[len(left) - i :] + right[:j]]))

        def tree(raw: bytes) -> tuple[int, ...]:
            if len(raw) == 1:
                return (ranks[raw],)
            half = len(raw) // 2
            side = part if half < PART else tree
            return join(side(raw[:half]), side(raw[half:]))

        part = lru_cache(PARTS)(tree)

        coded = [i.to_bytes(4, "little") for i in range(len(bytes_of))]

        def piece(text: str) -> bytes:
            """A piece that is itself a token is that token, whatever its merges give."""
            raw = text.encode()
            known = ranks.get(raw)
            return b"".join([coded[t] for t in tree(raw)]) if known is None else coded[known]

        self.join, self.tree, self.piece = join, tree, piece
        self.short_piece = short = lru_cache(PIECES)(piece)
        self.any_piece = lambda text: short(text) if len(text) <= PART else piece(text)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(text) >= LONG_TEXT:
            return b"".join(map(self.any_piece, (m.group() for m in self.find.finditer(text))))
        found = self.find.findall(text)
        return b"".join(map(self.short_piece if max(map(len, found), default=0) <= PART else self.any_piece, found))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes joined up a tree of halves."""
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@cache
def codec(ranks_path: str, pattern: str) -> ByteBpe:
    return ByteBpe(ranks_path, pattern)


def _strings(column: pa.Array) -> list[str]:
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _mapped(df: DataFrame, keep: list[str], more: list[T.StructField], source: str, make) -> DataFrame:
    """df's columns `keep` and the columns that make() gets from column `source`; a kept column gives way to a new one of its name."""
    keep = [c for c in keep if c not in {f.name for f in more}]
    names = [f"k{k}" for k in range(len(keep))]
    rows = df.select(*[df[f"`{c}`"].alias(n) for c, n in zip(keep, names, strict=True)], df[f"`{source}`"].alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *make(part.column("source"))], [*names, *[f.name for f in more]])

    schema = T.StructType([T.StructField(n, df.schema[c].dataType) for c, n in zip(keep, names, strict=True)] + more)
    return rows.mapInArrow(run, schema).toDF(*keep, *[f.name for f in more])


def encode_texts(df: DataFrame, keep: list[str], text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None, decoded: bool = False) -> DataFrame:
    """The columns `keep` of every row, `n_tokens` (long) and `ids` (binary: the ids as little-endian unsigned 32-bit integers).

    With decoded, the ids are decoded again by the same workers, into another binary column of that name.
    A null text is empty and has no ids; a string that is not UTF-8 has U+FFFD in place of its bad bytes; texts that
    look like special tokens are plain text. A very long text stays in one task, its pieces are taken one by one
    and a piece without end costs n log n. Equal rows all stay; an empty table gives an empty result; a kept
    column named like a result gives way to it. ranks_path must be a file that every worker has.
    """
    path, pattern = ranks_path or default_ranks(), pattern or default_pattern()

    def make(texts: pa.Array) -> list[pa.Array]:
        found = [codec(path, pattern).encode(x) for x in _strings(texts)]
        out = [pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(found, pa.binary())]
        return [*out, _decoded(found, path, pattern)] if decoded else out

    new = {"n_tokens": T.LongType(), "ids": T.BinaryType()} | ({"decoded": T.BinaryType()} if decoded else {})
    return _mapped(df, keep, [T.StructField(n, t) for n, t in new.items()], text_col, make)


def _decoded(ids: list[bytes | None], path: str, pattern: str) -> pa.Array:
    return pa.array([codec(path, pattern).decode(np.frombuffer(x or b"", "<u4")) for x in ids], pa.binary())


def decode_ids(df: DataFrame, keep: list[str], ids_col: str = "ids", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns `keep` of every row and `decoded`, the bytes (binary) of its ids; null ids are none, an unknown id is an error."""
    path, pattern = ranks_path or default_ranks(), pattern or default_pattern()

    def make(ids: pa.Array) -> list[pa.Array]:
        return [_decoded(ids.to_pylist(), path, pattern)]

    return _mapped(df, keep, [T.StructField("decoded", T.BinaryType())], ids_col, make)


def bpe_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: its text encoded, and the ids decoded again."""
    coded = encode_texts(docs, ["doc_id"], decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
