"""Toxicity: a classifier chain of linear models on the presence of words and stems.

Categories are predicted one after the other. The model of a category also reads the probabilities of all
earlier ones; in training these are out-of-fold predictions, so that a later model sees probabilities as
good as those it will meet, and not those of a model that knows the row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Labelled texts that the models are fitted on at most (those with the least hash), folds,
#: features by category, and the probability from which a document is toxic.
MAX_LABELLED, FOLDS, FEATURES, THRESHOLD = 6_000, 5, 224, 0.5
#: Letters in a stem.
STEMS = (4, 5, 6)
#: The chain, each category with the rule that derives its label from the labels of a row. The last decides.
CATEGORIES = {"low_quality": "quality <= 0", "toxic_prose": "toxic > 0 and quality > 0", "toxic": "toxic > 0"}

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """The distinct words of a text, and the stems that one, two or three of its words begin with."""
    found = set(_WORD.findall((text or "").lower()))
    stems = Counter([w[:k] for k in STEMS for w in found if len(w) > k])
    return found | {f"{s}{'*' * min(n, 3)}" for s, n in stems.items()} | {f"{s}*" for s, n in stems.items() if n > 1} | {f"{s}**" for s, n in stems.items() if n > 2}


@dataclass(frozen=True)
class Link:
    """One model of the chain: words and their weights, the weights of earlier probabilities, the bias."""

    name: str
    words: dict[str, int]
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def margin(self, found: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return found @ self.weights + earlier @ self.earlier + self.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 15) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the bias. Rows of the rarer value weigh more."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    mass = np.where(y > 0, max(1.0, ((1 - share) / share) ** 0.5), max(1.0, (share / (1 - share)) ** 0.5))
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-4
    for _ in range(rounds):
        p = sigmoid(x @ w)
        slope = x.T @ (mass * (p - y)) + penalty * w
        bend = (x * (mass * p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def pick_words(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """The columns whose presence tells most about y, `most` at most: signed log-likelihood ratio, ties by place; each has three rows at least."""
    yes, every, n, m = x[y > 0].sum(0).astype(float), x.sum(0).astype(float), max(1, int(y.sum())), max(1, int((1 - y).sum()))
    a, b = (yes + 0.5) / (n + 1), (every - yes + 0.5) / (m + 1)
    gain = (a - b) * np.log(a / b) + (a - b) * np.log((1 - b) / (1 - a))
    order = np.argsort(-gain, kind="stable")
    return order[every[order] >= 3][:most]


def presence(rows: list[set[str]], words: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(rows), len(words)))
    keys = words.keys()
    for k, found in enumerate(rows):
        for w in keys & found:
            x[k, words[w]] = 1
    return x


def fit_chain(x: np.ndarray, words: list[str], labels: dict[str, np.ndarray], folds: np.ndarray, features: int = FEATURES) -> list[Link]:
    """The chain in the order of labels, from the presence of words (a column each). A category with one value only gets a constant model.

    What a later link reads of an earlier one in training is predicted by a model whose words and weights come
    from the other folds alone.
    """
    chain: list[Link] = []
    earlier = np.zeros((len(x), 0))
    for name, y in labels.items():
        out = np.full(len(x), y.mean() if len(y) else 0.0)
        for fold in np.unique(folds):
            train = folds != fold
            if train.any() and 0 < y[train].sum() < train.sum():
                own = np.hstack([x[:, pick_words(x[train], y[train], features)], earlier])
                out[~train] = sigmoid(np.hstack([own[~train], np.ones(((~train).sum(), 1))]) @ fit_logistic(own[train], y[train]))
        top = pick_words(x, y, features)
        if len(y) and 0 < y.sum() < len(y):
            w = fit_logistic(np.hstack([x[:, top], earlier]), y)
        else:
            w = np.append(np.zeros(len(top) + earlier.shape[1]), 30.0 if len(y) and y.all() else -30.0)
        chain.append(Link(name, {words[c]: k for k, c in enumerate(top)}, w[: len(top)], w[len(top) : -1], float(w[-1])))
        earlier = np.hstack([earlier, out[:, None]])
    return chain


def predict(chain: list[Link], rows: list[set[str]]) -> np.ndarray:
    """Probabilities, a column for each category, each link reading those before it."""
    out = np.zeros((len(rows), 0))
    for link in chain:
        out = np.hstack([out, sigmoid(link.margin(presence(rows, link.words), out))[:, None]])
    return out


def sample_texts(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(at, text, fold, and a column of 0 or 1 for each category) of at most `most` distinct labelled texts, a materialized table.

    Those with the least hash of their text are chosen, by ids and hashes alone; only their texts move.
    """
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality")).filter("doc_id is not null and toxic is not null")
    texts = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text")).withColumn("at", F.xxhash64("text"))
    first = F.min(F.struct("toxic", F.coalesce("quality", F.lit(1)).alias("quality"), "doc_id")).alias("first")
    chosen = texts.select("doc_id", "at").join(marks, "doc_id").groupBy("at").agg(first).orderBy("at").limit(most)
    chosen = materialize(chosen.select("at", "first.*"), "chosen")
    # `most` rows of four numbers
    rows = texts.join(F.broadcast(chosen), ["doc_id", "at"]).dropDuplicates(["at"])
    return materialize(rows.select("at", "text", F.pmod("at", F.lit(FOLDS)).cast("int").alias("fold"), *[F.expr(f"int({rule})").alias(name) for name, rule in CATEGORIES.items()]), "sample")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word and stem of a partition of the sample, by fold: the texts that have it, and those of each category."""
    every: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        marks = list(zip(*(batch.column(name).to_pylist() for name in CATEGORIES), strict=True))
        for text, fold, mark in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), marks, strict=True):
            for w in words_of(text):
                row = every.setdefault((w, fold), [0] * (len(mark) + 1))
                row[0] += 1
                for k, yes in enumerate(mark):
                    row[k + 1] += yes
    columns = [pa.array([w for w, _ in every], pa.string()), pa.array([f for _, f in every], pa.int32()), *(pa.array([r[k] for r in every.values()], pa.int64()) for k in range(len(CATEGORIES) + 1))]
    yield pa.RecordBatch.from_arrays(columns, ["word", "fold", "n", *CATEGORIES])


def telling_words(sample: DataFrame, most: int) -> list[str]:
    """The words whose presence tells most about a category, as pick_words() ranks them: `most` for each category, over all folds and without each."""
    names = ["n", *CATEGORIES]
    parts = [(-1, F.lit(True)), *((k, F.col("fold") != k) for k in range(FOLDS))]
    counts = sample.mapInArrow(_count_words, "word string, fold int, n long, " + ", ".join(f"{c} long" for c in CATEGORIES))
    one = lambda where, c: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0))
    counts = materialize(counts.groupBy("word").agg(*[one(where, c).alias(f"{c}_{k}") for k, where in parts for c in names]).filter("`n_-1` >= 3"), "words")
    total = sample.withColumn("n", F.lit(1)).agg(*[one(where, c).alias(f"{c}_{k}") for k, where in parts for c in names]).first()
    gains = []
    for k, _ in parts:
        for c in CATEGORIES:
            yes, no = max(1, total[f"{c}_{k}"]), max(1, total[f"n_{k}"] - total[f"{c}_{k}"])
            some, every = F.col(f"`{c}_{k}`"), F.col(f"`n_{k}`")
            a, b = (some + 0.5) / (yes + 1), (every - some + 0.5) / (no + 1)
            gain = (a - b) * F.log(a / b) + (a - b) * F.log((1 - b) / (1 - a))
            gains.append(F.struct(F.lit(f"{c}_{k}").alias("model"), F.when(every >= 3, gain).alias("gain")))
    rows = counts.select("word", F.explode(F.array(*gains)).alias("x")).select("word", "x.*").filter("gain is not null")
    # one of a few models by partition, over the words of a bounded sample; tasks keep their first ones before the shuffle
    rank = F.row_number().over(W.partitionBy("model").orderBy(F.desc("gain"), "word"))
    return sorted(r["word"] for r in rows.withColumn("rank", rank).filter(F.col("rank") <= most).select("word").distinct().collect())


def _presence_bits(words: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    place = {w: k for k, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [place.keys() & words_of(t) for t in batch.column("text").to_pylist()]
            bits = np.packbits(presence(rows, place).astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("at"), *(batch.column(c) for c in CATEGORIES), pa.array([x.tobytes() for x in bits], pa.binary())], ["at", *CATEGORIES, "bits"])

    return run


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int, features: int = FEATURES) -> tuple[np.ndarray, list[str], dict[str, np.ndarray], np.ndarray]:
    """Which telling words each text of the sample has (a column each), these words, the labels of all categories and the folds.

    Texts stay on the executors: a bit for each telling word, and `most` rows at most, come to the driver.
    """
    sample = sample_texts(docs, labels, most)
    words = telling_words(sample, features)
    schema = "at long, " + ", ".join(f"{c} int" for c in CATEGORIES) + ", bits binary"
    rows = sample.mapInArrow(_presence_bits(words), schema).orderBy("at").toArrow()
    bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint8).reshape(rows.num_rows, -(-len(words) // 8))
    return np.unpackbits(bits, axis=1, count=len(words)), words, {c: rows[c].to_numpy().astype(float) for c in CATEGORIES}, rows["at"].to_numpy() % FOLDS


def fitted_chain(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Link]:
    """The chain, fitted on a sample of at most max_labelled distinct labelled texts, chosen by their hash."""
    return fit_chain(*labelled_rows(docs, labels, max_labelled))


def _probabilities(chain: list[Link], batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    every = frozenset().union(*(link.words.keys() for link in chain))
    for batch in batches:
        for k in range(0, batch.num_rows, 1_000):
            part = batch.slice(k, 1_000)
            yield part, predict(chain, [every & words_of(t) for t in part.column(text).to_pylist()])


def _score(chain: list[Link], limit: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, p in _probabilities(chain, batches, "__text"):
            kept = part.schema.names[:-1]
            out = [pa.array(p[:, i]) for i in range(len(chain))] + [pa.array(p[:, -1] >= limit)]
            yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(kept))] + out, kept + [f"p_{link.name}" for link in chain] + ["is_toxic"])

    return run


def _clean(chain: list[Link], limit: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, p in _probabilities(chain, batches, "text"):
            yield part.filter(pa.array(p[:, -1] < limit))

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of every row, with p_<category> for each link of the chain, and is_toxic.

    Every row is scored, without a shuffle, over its whole text. A null text counts as empty; rows whose id is
    null or repeated are scored like others; labels without a document, or with a null id or toxic value, are left
    out, a null quality counts as 1; several labels of one document count as toxic if one is; without labels nothing is toxic; an empty table
    gives an empty result. docs and labels need doc_id and text, and doc_id, toxic and quality; others don't
    matter, whatever their names. A column of `keep` that has the name of a result is left out.
    """
    chain = fitted_chain(docs, labels, max_labelled)
    results = [f"p_{link.name} double" for link in chain] + ["is_toxic boolean"]
    names = {x.split()[0] for x in results}
    kept = [c for c in keep if c not in names]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + results)
    return docs.select(*[F.col(f"`{c}`") for c in kept], docs["text"].alias("__text")).mapInArrow(_score(chain, threshold), schema)


def without_toxic(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score_toxicity() doesn't call toxic, with all their columns."""
    return docs.mapInArrow(_clean(fitted_chain(docs, labels, max_labelled), threshold), docs.schema)
