"""Language-model scoring: causal self-attention over subword ids, in numpy.

A text is the sequence of its subword ids, closed by an end. Self-attention (attention.py) predicts every id
from those before it, in overlapping windows of which each scores its new ids only, so that every id is scored
once; the score is the sum of log10 P(id | before), and the probabilities of all ids sum to one.

Counts of words, of ids and of their neighbours cover all training documents; the neighbours make classes and
first embeddings of ids. Then the network trains by stochastic gradient on every window of every training
document. Texts are cut into pieces of PIECE windows at most, and pieces are dealt by a hash to rounds and to
shards of about a fixed size; each shard trains a copy on its windows in the order of a hash, whichever task
holds it, and copies are averaged as whole numbers, so that neither the layout of the input nor the order of
tasks changes the model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attention import AHEAD, BATCH, CLASSES, CONTEXT, OWN, STRIDE, TAILS, WIDTH, Network, window_ids, window_places
from .common import joined_bytes, materialize, small_batches
from .hashing import mix
from .token_store import default_tokenizer, encoder

#: Words whose counts are broadcast, and the most bytes that such a word has: 17 MB in all. Others are joined.
HEAD, HEAD_BYTES = 200_000, 64
#: Windows of a piece of text that stay together; rounds of copies, windows of a copy, first and last rate of training.
PIECE, ROUNDS, SHARD, RATES = 64, 4, 65_536, (0.03, 0.003)
#: The commonest ids whose places next to an id, and near it, tell classes apart; how far "near" goes.
BESIDE, NEAR, REACH = 96, 32, 4
#: Copies are averaged in units of 2**-30.
_UNIT = float(1 << 30)


def is_held_out(doc_id: Column) -> Column:
    """Whether the remainder of the id's CRC-32 by ten is 0; a null id counts as the empty text, and is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in lower case (A to Z only), and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    some = pc.not_equal(lists.values, "").to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy()
    upto = np.concatenate([[0], np.cumsum(some)])
    return lists.values.filter(pa.array(some)), np.diff(upto[offsets])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text", 2 << 20):
        found = words_of(batch.column("text"))[0].value_counts()
        yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "c"])
        pa.default_memory_pool().release_unused()


def commonest(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows with the greatest n, `most` of them or fewer: those from the lowest eighth of a power of two that has room."""
    level = F.floor(F.log2(F.col(n).cast("double")) * 8).cast("int")
    sizes = {r["level"]: r["rows"] for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect()}  # 512 at most
    total, cut = 0, 1 << 20
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        cut = k
    return counts.filter(level >= cut)


def _packed(table: pa.Table) -> bytes:
    """A table as Arrow's stream of bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


@dataclass
class WordCounts:
    """Totals of the training words, ends of texts included."""

    tokens: int
    types: int
    texts: int

    def log_share(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


def id_kind(end_id: int) -> str:
    return "<u2" if end_id < 1 << 16 else "<u4"


def _coder(path: str, words: WordCounts, head: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each text: its ids in lower case, the base score of its common words, and its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = encoder(path), TaskContext.get().partitionId() << 40
        end = coder.tokenizer.get_vocab_size()
        common = pa.ipc.open_stream(head.value).read_all()
        names, times = common.column(0).combine_chunks(), np.append(common.column(1).to_numpy(), -1)
        for batch in small_batches(batches, "text", 2 << 20):
            ids, ends = coder.encode(pc.ascii_lower(batch.column("text").fill_null("")), end)
            flat = ids.astype(id_kind(end))
            found, counts = words_of(batch.column("text"))
            coded = found.dictionary_encode()
            c = times[pc.index_in(coded.dictionary, names).fill_null(-1).to_numpy()] if len(found) else np.zeros(1, np.int64)
            entry = coded.indices.to_numpy()
            n, text, in_head = len(counts), np.repeat(np.arange(len(counts)), counts), (c >= 0)[entry]
            base = np.bincount(text, np.where(c >= 0, words.log_share(np.maximum(c, 0)), 0.0)[entry], n) + words.log_share(np.array(words.texts))
            sure = np.bincount(text, in_head, n).astype(np.int64) + (words.texts > 0)
            tail = np.flatnonzero(~in_head)
            cuts = np.searchsorted(text[tail], np.arange(n + 1)).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(cuts), found.take(pa.array(tail)))
            raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), batch.column("doc_id"), batch.column("held"), batch.column("salt"), pa.array(counts.astype(np.int64) + 1), pa.array(sure), pa.array(base), rare, raw], ["row", "doc_id", "held", "salt", "n_tokens", "sure", "base", "words", "ids"])
            row += n
            pa.default_memory_pool().release_unused()  # workers live on, and what they keep adds up

    return run


_CODED = "row long, doc_id long, held boolean, salt long, n_tokens long, sure long, base double, words array<string>, ids binary"


def _id_batches(batches: Iterator[pa.RecordBatch], end_id: int, limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, ids of all its texts, offsets of texts)."""
    kind = np.dtype(id_kind(end_id))
    for batch in small_batches(batches, "ids", limit):
        raw, ends = joined_bytes(batch.column("ids"))
        yield batch, np.frombuffer(raw.tobytes(), kind).astype(np.int32), ends // kind.itemsize


def _cells(values: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(values)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(values[at])], ["id", "n"])


def _fill(rows: DataFrame, size: int) -> np.ndarray:
    """A vector of fixed size from the sums of (id, n) rows."""
    found = rows.groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found["id"].to_numpy()] = found["n"].to_numpy()
    return out


def _id_counts(end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(end_id + 1, np.int64)
        for _, ids, _ in _id_batches(batches, end_id):
            total += np.bincount(ids, minlength=len(total))
        yield _cells(total)

    return run


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """The place of every id in the order of counts, ties by id."""
    out = np.empty(len(counts), np.int32)
    out[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    return out


def _neighbours(rank: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How often each of the OWN commonest ids stands right after each of the BESIDE commonest, and 2 to REACH places after each of the NEAR commonest."""
    width = BESIDE + NEAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(OWN * width, np.int64)
        for _, ids, ends in _id_batches(batches, len(rank) - 1):
            place, inner = rank[ids], ends[1:-1]
            for gap in range(1, REACH + 1):
                most, shift = (BESIDE, 0) if gap == 1 else (NEAR, BESIDE)
                among = place[:-gap] < most
                across = inner[:, None] - np.arange(1, gap + 1)  # the last places of each text but the last
                across = across[(across >= 0) & (across < len(among))]
                among[across] = False
                at = np.flatnonzero(among)
                before, after = place[at], place[at + gap]
                near = after < OWN
                cells += np.bincount(after[near] * width + before[near] + shift, minlength=len(cells))
        yield _cells(cells)

    return run


@dataclass
class Vocabulary:
    """Classes, inputs and shares of ids; the end of a text is the last id."""

    counts: np.ndarray
    group: np.ndarray
    embedding: np.ndarray

    @property
    def end(self) -> int:
        return len(self.counts) - 1

    def inputs(self) -> np.ndarray:
        """The embedding of each id: its own for the commonest, that of its class for others."""
        rank = ranks_of(self.counts)
        return np.where(rank < OWN, rank, OWN + self.group).astype(np.int32)

    def log_share(self) -> np.ndarray:
        """log10 P(id | class); every id has a little."""
        mass = self.counts + 0.05
        return np.log10(mass / np.bincount(self.group, mass, CLASSES)[self.group])


def _profiles(cells: np.ndarray) -> np.ndarray:
    """Neighbours of each common id as unit vectors of square roots of shares, the near ones with less weight."""

    def unit(x: np.ndarray) -> np.ndarray:
        x = x + 1e-3 * x.sum(0) / max(1.0, x.sum())
        x = np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1e-12))
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    rows = cells.reshape(OWN, BESIDE + NEAR).astype(float)
    return np.hstack([unit(rows[:, :BESIDE]), 0.7 * unit(rows[:, BESIDE:])])


def vocabulary_of(counts: np.ndarray, cells: np.ndarray) -> Vocabulary:
    """Classes by k-means over the neighbours of common ids; embeddings are principal components.

    The other ids are dealt, by falling counts, to the last TAILS classes, which have about the same share of the
    corpus each.
    """
    rank = ranks_of(counts)
    used = np.argsort(rank)[:OWN]
    used = used[counts[used] > 0]
    group, table = np.full(len(counts), CLASSES - 1), np.zeros((OWN + CLASSES, WIDTH), np.float32)
    tail = np.argsort(rank)[OWN:]
    mass = np.cumsum(counts[tail] + 0.05)
    group[tail] = CLASSES - TAILS + np.minimum(mass / mass[-1] * TAILS, TAILS - 1).astype(int)
    if len(used):
        rows, weight = _profiles(cells)[: len(used)], np.sqrt(counts[used])
        heavy = min(len(used), 20 * CLASSES)
        centres, far = [rows[0]], np.full(heavy, np.inf)
        for _ in range(CLASSES - TAILS - 1):
            far = np.minimum(far, ((rows[:heavy] - centres[-1]) ** 2).sum(1) * weight[:heavy])
            centres.append(rows[int(np.argmax(far))])
        centres = np.array(centres)
        for _ in range(15):
            label = np.argmin((centres**2).sum(1)[None] - 2 * rows @ centres.T, 1)
            for k in np.unique(label):
                mine = label == k
                centres[k] = (rows[mine] * weight[mine, None]).sum(0) / weight[mine].sum()
        group[used] = label
        mean = (rows * weight[:, None]).sum(0) / weight.sum()
        _, _, axes = np.linalg.svd((rows - mean) * weight[:, None], full_matrices=False)
        axes = axes[:WIDTH] * np.sign(axes[:WIDTH, :1] + 1e-12)
        first, classes = (rows - mean) @ axes.T, (centres - mean) @ axes.T
        scale = 0.3 / np.maximum(first.std(0), 1e-6) if len(used) > 1 else 0.0
        table[: len(used), : len(axes)], table[OWN : OWN + len(centres), : len(axes)] = first * scale, classes * scale
    return Vocabulary(counts, group, table)


def _training_pieces(end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces of PIECE windows at most, whole texts mostly, with a hash of text and place, and the piece's number in its text.

    A piece but the first begins with the CONTEXT + 1 ids that its first window reads from before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(id_kind(end_id))
        for batch, ids, ends in _id_batches(batches, end_id):
            salt = mix(batch.column("salt").to_numpy().view(np.uint64))
            count = -(-np.diff(ends) // (STRIDE * PIECE))
            text = np.repeat(np.arange(len(count)), count)
            nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
            at = mix(salt[text] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            low = np.maximum(ends[:-1][text], ends[:-1][text] + nth * STRIDE * PIECE - CONTEXT - 1)
            high = np.minimum(ends[1:][text], ends[:-1][text] + (nth + 1) * STRIDE * PIECE)
            flat = ids.astype(kind)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(nth > 0), pa.array([flat[a:b].tobytes() for a, b in zip(low, high, strict=True)], pa.binary())], ["at", "later", "ids"])

    return run


def shards_of(batches: Iterator[pa.RecordBatch], itemsize: int) -> Iterator[pa.Table]:
    """The shards of sorted pieces; one of more than 2 * SHARD windows, as of very many equal rows, in parts."""
    kept: list[pa.RecordBatch] = []
    shard, windows = None, 0
    for batch in batches:
        own, at = batch.column("shard").to_pylist(), 0
        sizes = pc.binary_length(batch.column("ids")).to_numpy() // (itemsize * STRIDE) + 1
        for k in range(batch.num_rows):
            if own[k] != shard or windows >= 2 * SHARD:
                kept.append(batch.slice(at, k - at))
                if sum(x.num_rows for x in kept):
                    yield pa.Table.from_batches(kept)
                kept, at, shard, windows = [], k, own[k], 0
            windows += sizes[k]
        kept.append(batch.slice(at))
    if sum(x.num_rows for x in kept):
        yield pa.Table.from_batches(kept)


def piece_windows(table: pa.Table, end_id: int) -> tuple[int, Callable[[slice], np.ndarray]]:
    """How many windows pieces (at, later, ids) have, and slices of them, in the order of a hash of piece and place."""
    kind = np.dtype(id_kind(end_id))
    raw = table.column("ids").to_pylist()
    ids = np.frombuffer(b"".join(raw), kind).astype(np.int32)
    ends = np.concatenate([[0], np.cumsum([len(x) // kind.itemsize for x in raw])]).astype(np.int64)
    before = np.where(table.column("later").to_numpy(zero_copy_only=False), CONTEXT + 1, 0)
    text, nth = window_places(ends, before)
    order = np.argsort(mix(table.column("at").to_numpy().view(np.uint64)[text] + nth.astype(np.uint64)), kind="stable")
    text, nth = text[order].astype(np.int32), nth[order].astype(np.int32)
    return len(text), lambda part: window_ids(ids, ends, end_id, text[part], nth[part], before)


def _trainer(vocabulary: Vocabulary, start: np.ndarray, rates: tuple[float, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A copy of the network for each shard; puts out the sums of the copies' weights, in whole units, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs, total, copies = np.append(vocabulary.inputs(), -1), np.zeros(len(start), np.int64), 0
        group = np.append(vocabulary.group, -1)
        for table in shards_of(batches, np.dtype(id_kind(vocabulary.end)).itemsize):
            windows, ids_of = piece_windows(table, vocabulary.end)

            def some(part: slice, ids_of: Callable[[slice], np.ndarray] = ids_of) -> tuple[np.ndarray, np.ndarray]:
                seen = ids_of(part)
                return inputs[seen[:, :-1]], group[seen[:, CONTEXT + 1 :]]

            net = Network().load(start).train(some, windows, rates)
            total += np.rint(net.flat().astype(float) * _UNIT).astype(np.int64)
            copies += 1
        if copies:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), copies, np.int64))], ["id", "v", "n"])

    return run


def train(pieces: DataFrame, windows: int, vocabulary: Vocabulary) -> np.ndarray:
    """The weights after ROUNDS rounds, each over its own part of the pieces (at, later, ids), which have so many windows."""
    weights = Network(vocabulary.embedding).flat()
    shards = max(1, round(windows / (ROUNDS * SHARD)))
    step = (RATES[1] - RATES[0]) / ROUNDS
    for k in range(ROUNDS):
        part = pieces.filter(F.pmod(F.shiftrightunsigned("at", 40), F.lit(ROUNDS)) == k).withColumn("shard", F.pmod("at", F.lit(shards)).cast("int"))
        part = part.repartition("shard").sortWithinPartitions("shard", "at", "ids")
        copies = part.mapInArrow(_trainer(vocabulary, weights, (RATES[0] + k * step, RATES[0] + (k + 1) * step)), "id int, v long, n long")
        mean = copies.groupBy("id").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toArrow()
        if mean.num_rows:
            weights = np.zeros(len(weights))
            weights[mean["id"].to_numpy()] = mean["v"].to_numpy() / mean["n"].to_numpy() / _UNIT
    return weights


def _scorer(vocabulary: Vocabulary, weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, inputs, share = Network().load(weights), np.append(vocabulary.inputs(), -1), vocabulary.log_share()
        tables = net.tables()
        for batch, ids, ends in _id_batches(batches, vocabulary.end):
            text, nth = window_places(ends)
            score = np.zeros(batch.num_rows)
            for k in range(0, len(text), BATCH * AHEAD):
                mine = text[k : k + BATCH * AHEAD]
                seen = window_ids(ids, ends, vocabulary.end, mine, nth[k : k + BATCH * AHEAD])
                said, read = seen[:, CONTEXT + 1 :], inputs[seen[:, :-1]]
                hit, said = said >= 0, np.maximum(said, 0)
                found, group = share[said], vocabulary.group[said]
                for part in (slice(x, x + BATCH) for x in range(0, len(mine), BATCH)):
                    found[part] += net.log_classes(read[part], group[part], tables)
                found[~hit] = 0
                score += np.bincount(mine, found.sum(1), len(score))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEPT), pa.array(score)], [*_KEPT, "score"])

    return run


_KEPT = ("row", "doc_id", "held", "n_tokens", "sure", "base")


def fit(coded: DataFrame, end_id: int) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and the network's weights from training rows (salt, ids) of a table that is cheap to read."""
    counts = _fill(coded.select("ids").mapInArrow(_id_counts(end_id), "id int, n long"), end_id + 1)
    cells = _fill(coded.select("ids").mapInArrow(_neighbours(ranks_of(counts)), "id int, n long"), OWN * (BESIDE + NEAR))
    vocabulary = vocabulary_of(counts, cells)
    each = F.ceil(F.octet_length("ids") / float(np.dtype(id_kind(end_id)).itemsize * STRIDE))
    windows = coded.agg(F.coalesce(F.sum(each), F.lit(0)).alias("n")).first()["n"]
    pieces = coded.select("salt", "ids").mapInArrow(_training_pieces(end_id), "at long, later boolean, ids binary")
    return vocabulary, train(pieces, windows, vocabulary)


def score_texts(docs: DataFrame, tokenizer: str | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    Rows that are not held out are the training rows. Whole texts are read; a null text is empty and has its
    end only; repeated rows train and score as often as they stand there; null ids are held out; other columns
    are ignored; an empty table gives an empty result; without training rows every token is unknown, and the
    network is as it began. Words are runs between ASCII white space with A to Z in lower case; subword ids are
    of the whole text in that lower case. A very long text is one row of one task, but trains in pieces; very
    long words are counted and joined as others are, and never broadcast.
    """
    path = tokenizer or default_tokenizer()
    end_id = encoder(path).tokenizer.get_vocab_size()
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = rows.select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("salt"))
    training = rows.filter("not held")
    counts = materialize(training.select("text").mapInArrow(_counts, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    total, texts = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count(F.lit(1)).alias("v")).first(), training.count()
    words = WordCounts(total["c"] + texts, total["v"] + (texts > 0), texts)
    known = docs.sparkSession.sparkContext.broadcast(_packed(commonest(counts.filter(F.octet_length("word") <= HEAD_BYTES), "c", head).select("word", "c").toArrow()))
    coded = materialize(rows.mapInArrow(_coder(path, words, known), _CODED), "coded")
    vocabulary, weights = fit(coded.filter("not held"), end_id)

    scored = coded.select(*_KEPT, "ids").mapInArrow(_scorer(vocabulary, weights), "row long, doc_id long, held boolean, n_tokens long, sure long, base double, score double")
    tail = coded.select("row", F.explode("words").alias("word")).join(counts, "word", "left")
    c, floor = F.coalesce("c", F.lit(0)), words.tokens + 0.1 * (words.types + 1)
    sums = tail.groupBy("row").agg(F.sum((c > 0).cast("long")).alias("more"), F.sum(F.log10((c + 0.1) / F.lit(floor))).alias("base_more"))
    out = scored.join(sums, "row", "left")
    return out.select("doc_id", F.col("held").alias("held_out"), "n_tokens", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("base_more", F.lit(0.0))).alias("base_score"), "score")
