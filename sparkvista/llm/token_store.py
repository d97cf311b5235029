"""Token ids in ORC files: stripes with integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are dealt by ranges of their id and sorted, encoded in that order, and written as ORC, so that
files follow each other in ascending id order, stripes can be read in parallel, and a lookup by id skips
files, stripes and row groups by their minima, maxima and Bloom filters.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_dir, materialize, small_batches

#: Odd pieces that a worker remembers before it starts anew, plain pieces that pass the model at once, and
#: bytes of text in which pieces are told apart.
REMEMBERED, JOINED, TEXTS = 50_000, 500, 10 << 20
STRIPE_BYTES, INDEX_ROWS = 16 << 20, 1_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Letters whose class is the same for Python and for the library; pieces of such letters, digits and ASCII
#: signs, without apostrophes and "<", on one line or more; and what the public pattern of this vocabulary's
#: pre-tokenizer makes of them.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f"
_PLAIN = re.compile(f"[{_LETTERS}!-&(-;=-~]+(?:\\n[{_LETTERS}!-&(-;=-~]+)*")
_TOKEN = re.compile(f" ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s")


class PieceEncoder:
    """Encodes texts with a byte-level BPE of the tokenizers library, each distinct piece of a batch once.

    A byte-level pre-tokenizer starts a new token at every single blank between two characters that aren't
    white space. So a text is cut there, each distinct piece is encoded once by the library, and its ids are
    joined. Plain pieces go to the library's model, many at a time: where no id of the vocabulary spans two
    tokens of the pre-tokenizer, which is checked, their ids begin with a blank and join nothing else. Other
    pieces pass the library's whole chain, and texts with other blanks are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, np.ndarray | None] = {}
        show = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.table: dict[int, str] = {}  # the library's own character for each byte
        for c in [*range(0x800), *range(0x800, 0xD800, 0x40), *range(0x10000, 0x110000, 0x1000)]:
            self.table.update(zip(chr(c).encode(), "".join(w for w, _ in show(chr(c))), strict=True))
        back = {ord(c): b for b, c in self.table.items()}
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.plain = True
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            text = bytes(back[ord(c)] for c in token if ord(c) in back).decode("utf-8", "replace")
            self.opens[i] = text.startswith(" ")
            if text.strip() and "'" not in text and all(_PLAIN.fullmatch(x) for x in text.split()) and len(_TOKEN.findall(text)) > 1:
                self.plain = False

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _odd(self, piece: str) -> np.ndarray | None:
        """The ids of a blank and a piece that isn't plain; None where its neighbours in the text may matter."""
        if piece not in self.known:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[piece] = None if not piece or piece[0].isspace() or piece[-1].isspace() or "<|" in piece else self._whole(f" {piece}")
        return self.known[piece]

    def _pieces(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct pieces, each after a blank: all ids, where each piece's begin, and how many (-1: doubtful)."""
        fast = np.zeros(len(distinct), bool)
        if self.plain:
            fast = pc.match_substring_regex(distinct, f"^(?:{_PLAIN.pattern})$").to_numpy(zero_copy_only=False)
        plain = distinct.filter(pa.array(fast))
        cuts = pa.array(np.append(np.arange(0, len(plain), JOINED), len(plain)).astype(np.int32))
        ids: list[int] = []
        for some in pc.binary_join(pa.ListArray.from_arrays(cuts, plain), " ").to_pylist():
            ids += [t.id for t in self.tokenizer.model.tokenize(f" {some}".encode().decode("latin-1").translate(self.table))]
        flat = np.array(ids, "<u4")
        place, size = np.zeros(len(distinct), np.int64), np.full(len(distinct), -1, np.int64)
        starts = np.flatnonzero(self.opens[flat])
        place[fast], size[fast] = starts, np.diff(np.append(starts, len(flat)))
        more, at = [flat], len(flat)
        for k in np.flatnonzero(~fast):
            if (found := self._odd(distinct[k].as_py())) is not None:
                place[k], size[k] = at, len(found)
                more.append(found)
                at += len(found)
        return np.concatenate(more), place, size

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by end_id, in one array, and the offsets of the texts."""
        texts = texts.fill_null("")
        pieces = pc.split_pattern(texts, " ")
        starts, coded = pieces.offsets.to_numpy().astype(np.int64), pieces.values.dictionary_encode()
        starts, entry = starts - starts[0], coded.indices.to_numpy().astype(np.int32)
        flat, place, size = self._pieces(coded.dictionary)

        # a row's first piece has no blank before it; rows with doubtful pieces are encoded whole, in its place
        rows, first = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(starts)), starts[:-1]
        bad = size[entry] < 0
        heads = coded.dictionary.take(pa.array(entry[first])).to_pylist()
        bad[first] = [not h and n > 1 or h[:1].isspace() or h[-1:].isspace() for h, n in zip(heads, np.diff(starts), strict=True)]
        whole = np.zeros(len(texts), bool)
        whole[rows[bad]] = True
        head_ids = [self._whole(texts[k].as_py() if w else h) for k, (h, w) in enumerate(zip(heads, whole, strict=True))]
        head_size = np.array([len(x) for x in head_ids], np.int64)
        entry[first] = len(place) + np.arange(len(texts), dtype=np.int32)
        place, size = np.concatenate([place, len(flat) + np.cumsum(head_size) - head_size]), np.concatenate([size, head_size])
        flat = np.concatenate([flat, *head_ids])
        if whole.any():
            stays = ~whole[rows]
            stays[first] = True
            entry, rows = entry[stays], rows[stays]

        count = size[entry].astype(np.int32)
        before = np.cumsum(count) - count
        total = int(count.sum())
        out = np.full(total + len(texts), end_id, "<u4")
        at = np.arange(total, dtype=np.int32)
        out[at + np.repeat(rows, count)] = flat[at + np.repeat((place[entry] - before).astype(np.int32), count)]
        ends = np.bincount(rows, count, len(texts)).astype(np.int64) + 1
        return out, np.concatenate([[0], np.cumsum(ends)])


@cache
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _encode(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", TEXTS):
            ids, offsets = encoder(path).encode(batch.column("text"), end_id)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(np.diff(offsets))], ["doc_id", "ids", "n_tokens"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes (doc_id, ids, n_tokens) of every row to an ORC folder, in ascending order of the id.

    One shuffle, of the texts, by ranges of the id; encoding streams over the sorted rows, so that ids never
    cross the network. A null text is empty and keeps its end id; null ids come first; rows that share an id
    are ordered by a hash of their text and all kept; they are dealt by that hash and their place too, so that no
    task gets all rows of an id, or all null ids, or all equal rows. An empty table gives a folder without rows.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("salt", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("doc_id"), "h", "salt"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    coded = rows.mapInArrow(_encode(tokenizer or default_tokenizer(), end_id), "doc_id long, ids array<int>, n_tokens long")
    coded.write.option("orc.compress", "SNAPPY").option("orc.stripe.size", str(STRIPE_BYTES)).option("orc.row.index.stride", str(INDEX_ROWS)).option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, ids array<int>, n_tokens long").orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of the given ids; the predicate is pushed into the scan, where indexes and Bloom filters skip."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin([int(x) for x in doc_ids]))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        ends = lists.offsets.to_numpy().astype(np.int64)
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<u4").tobytes()
        crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("file"), batch.column("at"), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], ["doc_id", "file", "at", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row of an ORC folder, read back from its files.

    start: a file's start is the sum over the files before it (one small row for each file), a row's start
    adds the rows before it in its own file. Nothing is gathered beyond one file's ids and counts.
    """
    rows = read_tokens(spark, path).select("doc_id", "ids", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))
    rows = materialize(rows.mapInArrow(_sums, "doc_id long, file string, at long, n_tokens long, ids_crc32 long"), "digests")
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n_tokens").over(W.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("within", within).join(files, "file").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def store_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes docs to a new ORC folder in the shared folder, and returns what its files hold."""
    path = fresh_dir(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return token_digests(docs.sparkSession, path)
