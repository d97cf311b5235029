"""Hashes of words and word n-grams for whole Arrow batches at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20_240_229))
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP, _PLACE = np.uint64(0x9E3779B97F4A7C15), _RNG.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def powers(n: int, base: np.uint64 = _STEP) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and for each row the offset of its first word (one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    firsts = ends[:-1][ends[:-1] < ends[1:]]
    start[firsts] = inside[firsts]
    at = np.flatnonzero(start)
    rows = np.searchsorted(at, ends)
    where = np.flatnonzero(inside)
    first = np.flatnonzero(start[where])  # of each word, among the bytes inside words
    length = np.diff(np.append(first, len(where)))
    place = np.arange(len(where)) - np.repeat(first, length)
    values = _BYTES[data[where]] * powers(int(length.max(initial=1)))[place]
    return mix(np.add.reduceat(values, first) + length.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64), rows


def ngram_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every n-gram of words, with repeats, and the offsets of rows; a row with fewer words has one of them all."""
    counts = np.diff(rows)
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(grams)])
    first = np.repeat(rows[:-1] - offsets[:-1], grams) + np.arange(offsets[-1])
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    total = np.zeros(len(first), np.uint64)
    stop = np.repeat(rows[1:], grams)
    for k in range(n):
        total += np.where(first + k < stop, padded[first + k] * _PLACE[k], np.uint64(0))
    return mix(total + np.uint64(n)), offsets


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Joins sorted batches to tables of whole groups, of about `rows` rows or one larger group."""
    kept: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        held += batch.num_rows
        if held < rows:
            continue
        table = pa.Table.from_batches(kept)
        cut = int(np.flatnonzero(changes(table, keys))[-1]) if held else 0
        if cut:
            yield table.slice(0, cut)
        kept = table.slice(cut).combine_chunks().to_batches() if cut else kept
        held = held - cut
    if kept:
        yield pa.Table.from_batches(kept)


def changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether a row's key differs from that of the row before it; true for the first."""
    out = np.zeros(table.num_rows, bool)
    out[:1] = True
    for key in keys:
        column = table.column(key).combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks == 1 else column
        values = np.array(column.to_pylist(), object) if pa.types.is_binary(column.type) or pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False)
        out[1:] |= values[1:] != values[:-1]
    return out


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component in the graph of links a[k] - b[k]."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label
