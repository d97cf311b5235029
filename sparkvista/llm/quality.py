"""Quality rules: word and line statistics, and bands of the zstandard ratio.

A text is compressed whole and in fixed chunks of its UTF-8 bytes, what is left after the last whole chunk
included. Text that repeats itself compresses far better than prose, noise far worse; both ratios must stay
inside the band of the text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: (bytes from which the band holds, least whole ratio, greatest whole ratio). Short texts carry the frame's
#: overhead and little context, so their ratios are higher.
BANDS = ((0, 0.0, 2.0), (64, 0.42, 1.6), (200, 0.36, 1.05), (500, 0.33, 0.9), (1_000, 0.31, 0.85), (2_000, 0.30, 0.85), (5_000, 0.26, 0.85), (20_000, 0.22, 0.85))
#: Bytes in a chunk, the least and greatest ratio of one chunk, and the greatest share of chunks outside.
CHUNK, CHUNK_LOW, CHUNK_HIGH, BAD_SHARE = 2_048, 0.25, 0.85, 0.25
MIN_WORDS, REPEAT_PERCENT, LEVEL = 50, 50, 3
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_bytes long, ratio double, bad_chunk_share double"
)


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of `size` words which occurs twice or more; every occurrence counts."""
    n = len(words)
    if n <= size:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    window, distinct = code[: n - size + 1], len(ids)
    for k in range(1, size):  # renumbered at each step, so that the product stays far below 2**63
        if k > 1:
            window = np.unique(window, return_inverse=True)[1]
        window = window * distinct + code[k : n - size + 1 + k]
    _, at, times = np.unique(window, return_inverse=True, return_counts=True)
    twice = times[at] > 1
    cover = np.zeros(n, bool)
    for k in range(size):
        cover[k : n - size + 1 + k] |= twice
    return int(cover.sum())


def duplicate_lines(raw: bytes) -> int:
    seen: set[bytes] = set()
    found = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            found += line in seen
            seen.add(line)
    return found


def chunks_of(raw: bytes) -> list[bytes]:
    """All bytes of a text of CHUNK bytes or more, in chunks; a rest too short to be judged by itself ends the last one."""
    starts = list(range(0, len(raw) - CHUNK + 1, CHUNK))
    if not starts:
        return []
    if len(raw) - starts[-1] - CHUNK >= BANDS[1][0]:
        starts.append(starts[-1] + CHUNK)
    return [raw[k:to] for k, to in zip(starts, [*starts[1:], len(raw)], strict=True)]


def is_bad_chunk(chunk: bytes, pack: zstandard.ZstdCompressor) -> bool:
    """Whether a chunk's ratio is outside the chunk limits; a shorter one may reach the greatest ratio of its length."""
    high = CHUNK_HIGH if len(chunk) >= CHUNK else _band(len(chunk))[1]
    return not CHUNK_LOW <= len(pack.compress(chunk)) / len(chunk) <= high


def ratios(raw: bytes, pack: zstandard.ZstdCompressor) -> tuple[float, float]:
    """The ratio of the whole text, and the share of chunks with a ratio outside the chunk limits."""
    if not raw:
        return 1.0, 0.0
    whole = len(pack.compress(raw)) / len(raw)
    chunks = chunks_of(raw)
    return whole, sum(is_bad_chunk(c, pack) for c in chunks) / len(chunks) if chunks else 0.0


def _band(n_bytes: int) -> tuple[float, float]:
    return next((lo, hi) for least, lo, hi in reversed(BANDS) if n_bytes >= least)


def in_band(n_bytes: int, ratio: float, bad_share: float) -> bool:
    low, high = _band(n_bytes)
    return low <= ratio <= high and bad_share <= BAD_SHARE


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in SCHEMA.split(", ")])
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            words = raw.split()  # on the six ASCII white-space characters
            n, inside = len(words), b"".join(words)
            chars = len(inside) - _continuation(inside)
            symbols = len(inside) - len(inside.translate(None, SYMBOLS))
            repeated = repeat_words(words)
            failed = n < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * n
            ratio, bad = ratios(raw, pack)
            row = (doc_id.as_py(), n, chars, symbols, duplicate_lines(raw), repeated, failed, not failed and in_band(len(raw), ratio, bad), len(raw), ratio, bad)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema, strict=True)], schema=schema)


def _continuation(raw: bytes) -> int:
    """Bytes of the form 10xxxxxx, so that what is left counts code points."""
    return int(((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80).sum())


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: base statistics, compression figures and the verdict `kept`.

    No shuffle: every row is judged by itself, in the task that read it. A null text counts as empty (no
    words, base_failed); a null or repeated id is passed through; other columns of docs are ignored; an empty
    table gives an empty result. Whole texts are read, however long.
    """
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(_rows, SCHEMA)
