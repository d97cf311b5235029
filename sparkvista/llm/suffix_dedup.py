"""Suffix-array dedup: bytes of strings that occur twice anywhere are removed, by a column-wise BWT.

A removed byte lies in a string of `window` bytes that also starts elsewhere. Strings that are equal have the
same anchor, the least hash of the short strings in them, at the same place. So windows are dealt by anchor:
  1. Every text is cut into runs of windows with one anchor; runs whose anchor occurs once are done.
  2. Runs are counted by content; one of each is cut into pieces of at most SPAN windows with one distance to
     the anchor. All windows of a piece share its core, which is replaced by a symbol: what remains are at
     most SPAN - 1 bytes on either side.
  3. Pieces with one core meet in one task, and batches of them are sorted by the column-wise construction
     (column_bwt.py), one symbol of each piece a round. Neighbours with a common prefix of SPAN symbols are
     equal windows.
  4. What repeats goes back to all runs with that content, to the texts, and is cut out.
The pieces of a core that has more than HOT are dealt once more, by the bytes next to the core, so that the
construction never gets more than that many at once, however many documents share a passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .column_bwt import build
from .common import joined_bytes, materialize, only_keys, small_batches
from .hashing import grouped, mix, powers

WINDOW, ANCHOR, SPAN = 400, 64, 32
#: Pieces of a core beyond which they are dealt by the bytes beside it too; pieces in a batch of the construction.
HOT, BATCH = 4_096, 16_384
#: Bytes hashed at a time; a longer text is read in parts that overlap by a window.
_PART, _PLACES = 1 << 20, np.uint64((1 << 21) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RUN = "cls binary, at long, s0 int, n int, off int, ah long, ph long"


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = 2 * _PART + WINDOW
    return powers(n), powers(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))


_BYTES = np.random.Generator(np.random.PCG64(400)).integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs_of(data: np.ndarray, ends: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (row, start, windows, anchor - start, anchor's hash, hash of all bytes).

    The anchor of a window is the place of its least hash of `anchor` bytes, the first of equal ones; it
    depends on the window's bytes alone.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    up, down = _powers()
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:n], out=total[1:])
    least = ((mix((total[anchor:] - total[:-anchor]) * down[: n - anchor + 1]) & ~_PLACES) | np.arange(n - anchor + 1, dtype=np.uint64))
    width, span = window - anchor + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    where = (least & _PLACES).astype(np.int64)
    valid = np.zeros(len(where), bool)
    marks = np.zeros(len(where) + 1, np.int64)  # windows that end inside their row
    long = np.diff(ends) >= window
    np.add.at(marks, ends[:-1][long], 1)
    np.add.at(marks, ends[1:][long] - window + 1, -1)
    valid = np.cumsum(marks[:-1]) > 0
    start = valid.copy()
    start[1:] &= (where[1:] != where[:-1]) | ~valid[:-1]
    stop = valid.copy()
    stop[:-1] &= (where[1:] != where[:-1]) | ~valid[1:] | start[1:]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + window
    a = where[s]
    ah = mix((total[a + anchor] - total[a]) * down[a])
    ph = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    row = np.searchsorted(ends, s, "right") - 1
    return row, s - ends[row], e - s - window + 1, a - s, ah, ph


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text", _PART):
        data, ends = joined_bytes(batch.column("text"))
        parts = [(0, data, ends)]
        if len(data) > 2 * _PART - WINDOW:  # one long text
            parts = [(k, data[k : k + _PART + WINDOW - 1], None) for k in range(0, len(data) - WINDOW + 1, _PART)]
        for first, part, rows in parts:
            row, s0, n, off, ah, ph = runs_of(part, rows if rows is not None else np.array([0, len(part)]))
            keys = batch.select(["cls", "at"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array((s0 + first).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(ah.view(np.int64)), pa.array(ph.view(np.int64))], ["cls", "at", "s0", "n", "off", "ah", "ph"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the given runs: core, run, place of its first window in the run, bytes on both sides of the core, weight."""
    core = WINDOW - SPAN + 1
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for text, runs in zip(batch.column("text"), batch.column("runs"), strict=True):
            raw = text.as_py().encode()
            for r in runs.as_py():
                s0, last, a = r["s0"], r["s0"] + r["n"] - 1, r["s0"] + r["off"]
                for j in range((a - last) // SPAN, (a - s0) // SPAN + 1):
                    c = a - SPAN * j  # the core's first byte, and the last window's
                    low, high = max(s0, c - SPAN + 1), min(last, c)
                    code = hashlib.blake2b(raw[c : c + core], digest_size=16, key=j.to_bytes(2, "big")).digest()
                    for column, v in zip(out, (code, r["ah"], r["ph"], low - s0, raw[low:c], raw[c + core : high + WINDOW], r["weight"]), strict=True):
                        column.append(v)
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["core", "ah", "ph", "w", "before", "after", "weight"])


_PIECE = "core binary, ah long, ph long, w int, before binary, after binary, weight int"


def repeated_windows(kinds: np.ndarray, before: list[bytes], after: list[bytes], weight: np.ndarray) -> np.ndarray:
    """Which places of each piece start a window that occurs twice or more in the batch: (pieces, SPAN) flags.

    A piece is the bytes before its core, a symbol for its core (kinds), and those after; pieces are distinct,
    each stands for `weight` of them.
    """
    coded = [np.concatenate([np.frombuffer(b, np.uint8) + np.uint16(1), np.array([257 + k], np.uint16), np.frombuffer(a, np.uint8) + np.uint16(1)]) for k, b, a in zip(kinds.tolist(), before, after, strict=True)]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int64)
    _, prefix, owner, length = build(np.concatenate(coded) if coded else np.zeros(0, np.uint16), starts)
    full = np.flatnonzero(length >= SPAN)  # suffixes that begin a window: it has SPAN symbols, the core among them
    flags = np.zeros((len(coded), SPAN), bool)
    if len(full):
        common = np.minimum.reduceat(prefix, np.column_stack([np.append(0, full[:-1] + 1), full + 1]).ravel()[: 2 * len(full) - (full[-1] + 1 >= len(prefix))])[::2]
        group = np.cumsum(common < SPAN) - (common[0] < SPAN)
        times = np.bincount(group, weight[owner[full]])
        again = times[group] > 1
        place = np.diff(starts)[owner[full]] - length[full]
        flags[owner[full][again], place[again]] = True
    return flags


def _numbers(keys: list[bytes]) -> np.ndarray:
    kinds = {c: k for k, c in enumerate(dict.fromkeys(keys))}
    if len(kinds) > 65_000:
        raise ValueError("too many cores in a batch")
    return np.array([kinds[c] for c in keys], np.int64)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that repeat, as (run, first and last place in it), from batches of pieces with whole cores."""
    for table in grouped(batches, ["core"], BATCH):
        frame = table.to_pandas().drop_duplicates(["core", "ah", "ph", "w"])
        # pieces with equal bytes are one string of the collection; a run counts as often as its content occurs
        text = frame.groupby(["core", "before", "after"], sort=False)
        string, weight = text.ngroup().to_numpy(), text["weight"].sum()
        core, before, after = (list(x) for x in zip(*weight.index, strict=True))
        flags = repeated_windows(_numbers(core), before, after, weight.to_numpy())
        edge = np.diff(np.pad(flags[string], ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1] - 1
        ah, ph, w = (frame[c].to_numpy() for c in ("ah", "ph", "w"))
        yield pa.RecordBatch.from_arrays([pa.array(ah[row]), pa.array(ph[row]), pa.array((w[row] + low).astype(np.int32)), pa.array((w[row] + high).astype(np.int32))], ["ah", "ph", "low", "high"])


def _window_code(core: bytes, left: bytes, right: bytes) -> bytes:
    return hashlib.blake2b(core + bytes([len(left)]) + left + right, digest_size=16).digest()


def _repeat_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The codes of windows that repeat, from batches of distinct pieces (key, core, before, after, weight) with whole keys."""
    for table in grouped(batches, ["key"], BATCH):
        key, core, before, after = (table.column(c).to_pylist() for c in ("key", "core", "before", "after"))
        flags = repeated_windows(_numbers(key), before, after, table.column("weight").to_numpy())
        codes = {_window_code(core[k], before[k][p:], after[k][: SPAN - 1 - len(before[k]) + p]) for k, p in zip(*(x.tolist() for x in np.nonzero(flags)), strict=True)}
        yield pa.RecordBatch.from_arrays([pa.array(list(codes), pa.binary())], ["code"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the given pieces by itself: a digest of its core and the bytes around it."""
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for r in batch.to_pylist():
            for k in range(len(r["before"]) + 1):
                left = r["before"][k:]
                right = r["after"][: SPAN - 1 - len(left)]
                if len(left) + len(right) == SPAN - 1:
                    code = _window_code(r["core"], left, right)
                    for column, v in zip(out, (code, r["ah"], r["ph"], r["w"] + k, r["weight"]), strict=True):
                        column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)], ["code", "ah", "ph", "low", "weight"])


def _halved(pieces: DataFrame, width: int) -> DataFrame:
    """Each piece (key, core, before, after, low, weight) as two, with the windows of half as many lengths before the core.

    Windows with `low` to low + width - 1 bytes before the core all hold the last `low` bytes there and the first
    ones after it: these are the key, so that equal windows meet again, in a smaller group.
    """
    half, last = width // 2, SPAN - 1
    rows = pieces.withColumn("low", F.explode(F.array(F.col("low"), F.col("low") + half))).withColumn("top", F.col("low") + half - 1)
    rows = rows.filter((F.length("before") >= F.col("low")) & (F.length("after") >= last - F.col("top")))
    end = lambda c, n: F.expr(f"substring({c}, length({c}) - least(length({c}), {n}) + 1, {n})")
    rows = rows.withColumns({"before": end("before", "top"), "after": F.expr(f"substring(after, 1, {last} - low)")})
    key = F.unhex(F.md5(F.concat("core", F.unhex(F.lpad(F.hex("low"), 2, "0")), end("before", "low"), F.expr(f"substring(after, 1, {last} - top)"))))
    return rows.withColumn("key", key).groupBy("key", "core", "before", "after", "low").agg(F.sum("weight").alias("weight"))


def _hot_repeats(pieces: DataFrame) -> DataFrame:
    """Repeats among pieces of cores that very many have: dealt anew by bytes beside the core until groups are small.

    With windows of one length before the core a key is a whole window, and its group one piece; so this ends.
    Equal pieces are added up before every shuffle.
    """
    parts = pieces.groupBy("core", "before", "after").agg(F.sum("weight").alias("weight")).withColumn("key", F.col("core")).withColumn("low", F.lit(0))
    width, codes = SPAN, None
    while True:
        if width < SPAN:
            counts = materialize(parts.groupBy("key").agg(F.count(F.lit(1)).alias("pieces"), F.sum("weight").alias("times")).filter("times > 1"), "keys")
            cold = parts.join(counts.filter(F.col("pieces") <= HOT).select("key"), "key", "left_semi")
            found = cold.select("key", "core", "before", "after", "weight").repartition("key").sortWithinPartitions("key").mapInArrow(_repeat_codes, "code binary")
            codes = found if codes is None else codes.unionByName(found)
            hot = counts.filter(F.col("pieces") > HOT).select("key")
            if hot.isEmpty():
                break
            parts = parts.join(hot, "key", "left_semi")
        parts = materialize(_halved(parts, width), "halves")
        width //= 2
    rows = pieces.select("core", "ah", "ph", "w", "before", "after", "weight").mapInArrow(_windows, "code binary, ah long, ph long, low int, weight int")
    return rows.join(materialize(codes.distinct(), "codes"), "code", "left_semi").select("ah", "ph", "low", F.col("low").alias("high"))


def _cut(keep: tuple[str, ...], texts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            figures: list[tuple] = []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = (text.as_py() or "").encode()
                kept, at, removed, count = [], 0, 0, 0
                end = -1
                for low, high in sorted((x["low"], x["high"] + WINDOW) for x in spans.as_py() or ()):
                    if low > end:  # runs that touch are one
                        kept.append(raw[at:low])
                        count += 1
                        end = low
                    removed += max(0, high - max(end, low))
                    end = max(end, high)
                    at = end
                kept.append(raw[at:])
                left = b"".join(kept)
                figures.append((len(raw), removed, count, hashlib.sha256(left).hexdigest(), left))
            columns = [pa.array([f[k] for f in figures], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                columns, names = [*columns, pa.array([f[4] for f in figures], pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, *names])

    return run


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(cls, spans): for each text, by its MD5, the first and last starts of windows that also start elsewhere."""
    runs = materialize(texts.filter(F.octet_length("text") >= WINDOW).mapInArrow(_runs, _RUN), "runs")
    # as a table, so that the runs are dealt by themselves and Spark can split those of one anchor
    often = materialize(runs.groupBy("ah").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("ah"), "anchors")
    runs = materialize(runs.join(often, "ah", "left_semi"), "runs")
    first = F.min(F.struct("cls", "at", "s0")).alias("first")
    unique = runs.groupBy("ah", "ph").agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("weight"), first, F.first("n").alias("n"), F.first("off").alias("off"))
    # a run with an anchor of its own content only, and once, has nothing to be compared with
    unique = unique.select(F.col("first.cls").alias("cls"), F.col("first.at").alias("at"), F.struct(F.col("first.s0").alias("s0"), "n", "off", "ah", "ph", "weight").alias("run"))
    wanted = materialize(unique.groupBy("cls", "at").agg(F.collect_list("run").alias("runs")), "wanted")
    pieces = only_keys(texts, wanted, ["cls", "at"]).join(wanted, ["cls", "at"]).select("text", "runs").mapInArrow(_pieces, _PIECE)
    pieces = materialize(pieces, "pieces")
    counts = pieces.groupBy("core").agg(F.count(F.lit(1)).alias("pieces"), F.sum("weight").alias("times"))
    counts = materialize(counts.filter("times > 1"), "cores")
    cold = pieces.join(counts.filter(F.col("pieces") <= HOT).select("core"), "core", "left_semi")
    found = cold.repartition("core").sortWithinPartitions("core").mapInArrow(_repeats, "ah long, ph long, low int, high int")
    hot = counts.filter(F.col("pieces") > HOT).select("core")
    if not hot.isEmpty():
        found = found.unionByName(_hot_repeats(pieces.join(hot, "core", "left_semi")))
    found = materialize(found, "repeats")
    spans = runs.select("cls", "s0", "ah", "ph").join(found, ["ah", "ph"]).select("cls", (F.col("s0") + F.col("low")).alias("low"), (F.col("s0") + F.col("high")).alias("high"))
    return materialize(spans.distinct().groupBy("cls").agg(F.collect_list(F.struct("low", "high")).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with texts also `kept`, the bytes left.

    Every byte is removed that lies in a string of WINDOW bytes which also starts anywhere else, in the same
    text or another, overlaps included; copies, even rows that agree in all columns, count for each other.
    Strings never reach across two texts, and are judged on the input. A null text is empty; texts shorter
    than a window lose nothing; null and repeated ids are passed through; other columns of docs are ignored;
    an empty table gives an empty result. A span is a maximal run of removed bytes.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).withColumn("cls", _text_key(F.col("text")))
    spans = repeated_spans(rows.select("cls", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("at"), "text"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    touched = only_keys(rows, spans, ["cls"])
    if touched is rows:
        return rows.join(spans, "cls", "left").select("doc_id", "text", "spans").mapInArrow(_cut(("doc_id",), texts), schema)
    cut = touched.join(spans, "cls").select("doc_id", "text", "spans").mapInArrow(_cut(("doc_id",), texts), schema)
    rest = rows.join(F.broadcast(spans.select("cls").distinct()), "cls", "left_anti")
    whole = [F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")]
    return cut.unionByName(rest.select("doc_id", *whole, *([F.coalesce("text", F.lit("")).cast("binary").alias("kept")] if texts else [])))
