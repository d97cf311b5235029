"""Burrows-Wheeler transform of a collection of strings, built column by column.

Each round inserts one symbol of every string, from their ends to their starts, into the sorted list of all
suffixes so far, and updates the symbols before them (the transform) and the common prefixes of neighbours.
Between rounds that state lies in files, read and written in sequence. A collection is a bounded batch of
short strings; Spark deals the batches.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

END = 0
_BLOCK = 256


class _State:
    """The sorted suffixes on disk: symbol before, common prefix with the one before, string, length."""

    kinds = {"symbol": np.uint16, "prefix": np.uint16, "string": np.uint32, "length": np.uint16}

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, **columns: np.ndarray) -> None:
        for name, values in columns.items():
            values.astype(self.kinds[name], copy=False).tofile(os.path.join(self.folder, name))

    def read(self, name: str) -> np.ndarray:
        return np.fromfile(os.path.join(self.folder, name), self.kinds[name])


def range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(values[first[k] : last[k] + 1]) for all k; long ranges go over the minima of blocks."""
    out = np.empty(len(first), values.dtype)
    short = last - first < 4 * _BLOCK
    padded = np.append(values, values[-1:])

    def reduce(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(v, np.column_stack([a, b + 1]).ravel())[::2] if len(a) else v[:0]

    out[short] = reduce(padded, first[short], last[short])
    a, b = first[~short], last[~short]
    if len(a):
        blocks = np.minimum.reduceat(values, np.arange(0, len(values), _BLOCK))
        x, y = a // _BLOCK + 1, b // _BLOCK
        ends = np.minimum(reduce(padded, a, x * _BLOCK - 1), reduce(padded, y * _BLOCK, b))
        out[~short] = np.minimum(ends, reduce(np.append(blocks, blocks[-1:]), x, y - 1))
    return out


def build(strings: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The transform of a collection: (symbol before, common prefix, string, length) of every suffix in order.

    strings: all symbols (1 to 65,535), one string after the other; starts: where each begins, and the end.
    Suffixes that are equal up to their ends stand in the order of their strings; the end of a string equals
    nothing, so that common prefixes stop there.
    """
    count, lengths = len(starts) - 1, np.diff(starts)
    ends = starts[1:]

    def before(string: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The symbol before the suffix of this length."""
        at = ends[string] - length - 1
        more = length < lengths[string]
        return np.where(more, strings[np.where(more, at, 0)] if len(strings) else 0, END).astype(np.uint16)

    with tempfile.TemporaryDirectory() as folder:
        state = _State(folder)
        every = np.arange(count, dtype=np.uint32)
        state.write(symbol=before(every, np.zeros(count, np.int64)), prefix=np.zeros(count), string=every, length=np.zeros(count))
        for done in range(int(lengths.max(initial=0))):
            symbol, prefix, length = state.read("symbol"), state.read("prefix"), state.read("length")
            fresh = (length == done) & (symbol != END)
            # a suffix with symbol c before it extends to one that starts with c; these keep their order
            order = np.argsort(symbol, kind="stable")
            rank = np.flatnonzero(fresh[order])
            at = count + rank - int((symbol == END).sum())
            origin = order[rank]

            # the prefixes that change: of the new suffixes, and of those that follow them
            near = np.unique(np.concatenate([rank, rank + 1]))
            near = near[(near > 0) & (near < len(order))]
            near = near[(symbol[order[near]] == symbol[order[near - 1]]) & (symbol[order[near]] != END)]
            common = range_minima(prefix, order[near - 1] + 1, order[near]) + 1
            place = count + near - int((symbol == END).sum())

            new = np.zeros(len(symbol) + len(rank), bool)
            new[at] = True
            string = state.read("string")

            def merge(old: np.ndarray, added: np.ndarray, new: np.ndarray = new) -> np.ndarray:
                out = np.empty(len(new), old.dtype)
                out[new], out[~new] = added, old
                return out

            whose = string[origin]
            prefix = merge(prefix, np.zeros(len(rank), np.uint16))
            prefix[place] = common
            state.write(symbol=merge(symbol, before(whose, np.full(len(whose), done + 1))), prefix=prefix, string=merge(string, whose), length=merge(length, np.full(len(rank), done + 1, np.uint16)))
        return tuple(state.read(name) for name in ("symbol", "prefix", "string", "length"))
