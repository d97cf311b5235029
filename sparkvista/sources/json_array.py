"""A JSON array read in splits: no task needs to read a file from its beginning.

Files are read as fragments between commas, which Spark's reader deals in splits. What a split does to the state
of the text (inside a string, depth of brackets) is a small record that composes with that of the next split; a
prefix scan over these tells the state in which each split begins. Elements are then cut at the commas of depth
one. A backslash before a comma is no JSON, so that no escape spans two fragments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import stored

_STEP = np.zeros(256, np.int8)
_STEP[[ord("["), ord("{")]], _STEP[[ord("]"), ord("}")]] = 1, -1


def fragments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(value, file, block): the text between commas, in order within a split, which `block`, its first byte, names."""
    return spark.read.option("lineSep", ",").text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def heads(rows: DataFrame) -> DataFrame:
    """(file, opens): whether the first character of a file that is not blank is "[". One scan without Python."""
    first = F.ltrim(F.regexp_replace("value", "^[\\s\\x{FEFF}]+", ""))
    seen = rows.select("file", "block", F.monotonically_increasing_id().alias("at"), F.substring(first, 1, 1).alias("c"))
    return seen.groupBy("file").agg(F.min_by("c", F.struct("block", "at")).alias("c")).select("file", (F.col("c") == "[").alias("opens"))


def only_value(text: Column) -> Column:
    """An object whose field v is the text: Spark's parser ignores what follows a value, but not within an object."""
    return F.concat(F.lit('{"v":'), text, F.lit("}"))


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing more; NaN and infinite numbers are values."""
    parsed = F.from_json(only_value(text), "q int, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return F.coalesce(parsed["_bad"].isNull(), F.lit(False)) & (F.trim(text) != "")


def _scan(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of fragments, each closed by its comma: last places, steps of depth, and whether an odd number of quotes stands before, by byte."""
    raw = np.frombuffer(b",".join(parts) + b",", np.uint8)
    quote = raw == 34
    back = raw == 92
    if back.any():
        at = np.arange(len(raw), dtype=np.int64)
        plain = np.maximum.accumulate(np.where(back, -1, at))
        hit = np.flatnonzero(quote)
        hit = hit[hit > 0]
        quote[hit[(hit - 1 - plain[hit - 1]) % 2 == 1]] = False
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    return ends, _STEP[raw], np.cumsum(quote, dtype=np.int64) % 2 == 1


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, list[bytes]]]:
    """Fragments of a batch by split, with the row of the first."""
    keys = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True))
    values, low = batch.column("value").cast(pa.binary()).to_pylist(), 0
    for k in range(1, len(keys) + 1):
        if k == len(keys) or keys[k] != keys[low]:
            yield keys[low], low, values[low:k]
            low = k


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split: whether it turns inside and outside about, and its change of depth if it begins outside, or inside, a string."""
    split, odd, outside, inside = None, False, 0, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [split[0]], "block": [split[1]], "odd": [odd], "outside": [outside], "inside": [inside]})

    for batch in batches:
        for key, _, parts in _runs(batch):
            if key != split:
                if split is not None:
                    yield row()
                split, odd, outside, inside = key, False, 0, 0
            _, step, turned = _scan(parts)
            turned = turned ^ odd
            outside, inside = outside + int(step[~turned].sum(dtype=np.int64)), inside + int(step[turned].sum(dtype=np.int64))
            odd = bool(turned[-1])
    if split is not None:
        yield row()


def states(rows: DataFrame) -> DataFrame:
    """(file, block, within, depth, until, open): the state in which each split begins, and its depth and whether a string is open at its end; one row for each split."""
    effects = rows.mapInArrow(_effects, "file string, block long, odd boolean, outside long, inside long")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    within = F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1
    found = effects.withColumn("within", within).withColumn("step", F.when(F.col("within"), F.col("inside")).otherwise(F.col("outside")))
    found = found.withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0)))
    return found.select("file", "block", "within", "depth", (F.col("depth") + F.col("step")).alias("until"), (F.col("within") != F.col("odd")).alias("open"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements and pieces of them: kind 0 is whole, 1 begins in its split and does not end there, 2 began before.

    Pieces that go on in the next split keep their last comma.
    """
    split, held, at, fresh, odd, depth = None, [], 0, True, False, 0
    out: list[tuple[str, int, int, int, bytes]] = []

    def close() -> None:
        if split is not None:
            out.append((*split, at, 1 if fresh else 2, b"".join(p + b"," for p in held)))

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        out.clear()
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "block", "at", "kind", "text"])

    for batch in batches:
        for key, low, parts in _runs(batch):
            if key != split:
                close()
                split, held, at, fresh = key, [], 0, key[1] == 0
                odd, depth = batch.column("within")[low].as_py(), batch.column("depth")[low].as_py()
            ends, step, turned = _scan(parts)
            turned = turned ^ odd
            level = np.cumsum(np.where(turned, 0, step), dtype=np.int64) + depth
            odd, depth, done = bool(turned[-1]), int(level[-1]), 0
            for k in np.flatnonzero((level[ends] == 1) & ~turned[ends]).tolist():
                out.append((*split, at, 0 if fresh else 2, b",".join([*held, *parts[done : k + 1]])))
                held, done, at, fresh = [], k + 1, at + 1, True
            held += parts[done:]
        yield batch_of()
    close()
    yield batch_of()


def elements(rows: DataFrame, begins: DataFrame) -> DataFrame:
    """(file, block, at, text, only) of the elements of arrays, in the order (file, block, at); text is the JSON of one element.

    begins has a row for each split of the scan, as Spark's driver has, and is sent to every task, so that fragments
    stay where and as they are read. What is cut is a table, so that it is cut once. Elements within a split are whole; of others, two pieces a split are shuffled.
    only: the text is that of an array without a comma of depth one.
    """
    known = F.broadcast(begins.select("file", "block", "within", "depth"))
    cut = rows.join(known, ["file", "block"]).mapInArrow(_cut, "file string, block long, at long, kind int, text binary")
    cut = stored(cut.withColumn("text", F.col("text").cast("string")), "elements")
    whole = cut.filter("kind = 0").select("file", "block", "at", "text", F.lit(False).alias("last"), F.lit(False).alias("only"))
    order = W.partitionBy("file").orderBy("block", "at")
    pieces = cut.filter("kind <> 0").withColumn("nth", F.sum((F.col("kind") == 1).cast("long")).over(order))
    joined = pieces.groupBy("file", "nth").agg(F.array_sort(F.collect_list(F.struct("block", "at", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "")
    last = F.col("nth") == F.max("nth").over(W.partitionBy("file"))
    begin = F.get("p", F.lit(0))
    joined = joined.select("file", begin["block"].alias("block"), begin["at"].alias("at"), text.alias("text"), last.alias("last"))
    joined = joined.withColumn("only", F.col("last") & (F.col("block") == 0) & (F.col("at") == 0))
    both = whole.unionByName(joined)
    inner = F.when((F.col("block") == 0) & (F.col("at") == 0), F.regexp_replace("text", "^[\\s\\x{FEFF}]*\\[", "")).otherwise(F.col("text"))
    inner = F.when(F.col("last"), F.regexp_replace(inner, "\\]\\s*,?\\s*$", "")).otherwise(inner)
    return both.select("file", "block", "at", F.trim(F.regexp_replace(inner, "^\\s+|\\s+$", "")).alias("text"), "only").filter("not (only and text = '')")


def array_files(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame | None, list[str], list[str]]:
    """The elements of files that hold one JSON array; these files, and all others: names only, as the driver lists them.

    An array begins with "[", ends at depth 0, and every element is JSON. A truncated one is none. Elements are cut
    once: those that are checked are those that are read.
    """
    rows = fragments(spark, paths)
    found = {r["file"]: r["opens"] for r in heads(rows).collect()}
    likely = [f for f, opens in found.items() if opens]
    if not likely:
        return None, [], list(found)
    begins = stored(states(fragments(spark, list(map(path_of, likely)))), "states")
    ends = begins.groupBy("file").agg(F.max_by(F.struct("until", "open"), "block").alias("end")).filter("end.until = 0 and not end.open")
    sound = [r["file"] for r in ends.collect()]
    if not sound:
        return None, [], list(found)
    rows = fragments(spark, list(map(path_of, sound)))
    cut = elements(rows, begins)
    broken = {r["file"] for r in cut.filter(~is_json(F.col("text"))).select("file").distinct().collect()}
    arrays = [f for f in sound if f not in broken]
    if broken:
        cut = cut.filter(~F.col("file").isin(sorted(broken)))
    return cut if arrays else None, arrays, [f for f in found if f not in set(arrays)]


def path_of(file: str) -> str:
    """The path, without patterns, of a file as a scan names it."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(file))
