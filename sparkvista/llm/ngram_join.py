"""Similarity self-join on word n-grams: MinHash banding, then verification on the full n-gram sets.

Exact copies form a class (one MD5 of the text) and are treated once. Signatures of classes are banded, with
bands and rows chosen for a target recall. Classes that share a band are compared on their signatures inside
the task that holds the bucket, and the families this gives are compared on their n-gram sets. Large buckets
and families are cut into blocks; each pair of blocks is compared in a task of its own. Only links counted
by class and spanning edges leave a task, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_bytes, materialize, only_keys, small_batches, small_join
from .hashing import changes, components, grouped, mix, ngram_hashes, word_hashes

SIZE, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 128
#: Classes in a block of a bucket, and in a block of a family whose texts are compared.
BUCKET_BLOCK, FAMILY_BLOCK = 1_024, 512
#: Signatures that agree in a smaller share belong to different families: over five standard deviations below THRESHOLD.
SKETCH_LIMIT = 0.6


def bands_for(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which the recall at the threshold holds with at most `most` hashes."""
    found = [(math.ceil(math.log(1 - recall) / math.log(1 - threshold**r)), r) for r in range(1, 17)]
    return max((x for x in found if x[0] * x[1] <= most), key=lambda x: x[1])


def class_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _signatures(size: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    rng = np.random.Generator(np.random.PCG64(7))
    scale = rng.integers(1, 1 << 62, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(1, 1 << 62, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 19):
            words, ends = word_hashes(*joined_bytes(batch.column("text")))
            grams, at = ngram_hashes(words, ends, size)
            some = np.flatnonzero(np.diff(at))
            signature = np.zeros((bands * rows, len(some)), np.uint64)
            buffer = np.empty_like(grams)
            for k in range(bands * rows if len(some) else 0):
                np.multiply(grams, scale[k], out=buffer)
                np.add(buffer, shift[k], out=buffer)
                signature[k] = np.minimum.reduceat(buffer, at[some])
            keys = np.zeros((len(some), bands), np.uint64)
            for k in range(bands):
                part = np.full(len(some), k + 1, np.uint64)
                for r in range(rows):
                    part = mix(part * np.uint64(0x9E3779B97F4A7C15) + mix(signature[k * rows + r]))
                keys[:, k] = part
            sketch = np.ascontiguousarray(mix(signature).T.astype(np.uint8))
            lists, codes = [None] * batch.num_rows, [None] * batch.num_rows
            for k, row in enumerate(some):
                lists[row], codes[row] = keys[k].view(np.int64), sketch[k].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("cls"), pa.array(lists, pa.list_(pa.int64())), pa.array(codes, pa.binary())], ["doc_id", "cls", "bands", "sketch"])

    return run


def _block(members: Column, block: int, node: str = "cls") -> Column:
    """The block, by a hash of its node, that a member of a group of `members` rows belongs to."""
    return F.pmod(F.xxhash64(node), F.ceil(members / float(block))).cast("int")


def block_pairs(df: DataFrame, members: Column, block: int, node: str = "cls") -> DataFrame:
    """A row for each pair of blocks (p, q), p <= q, that a member of a group of `members` rows belongs to, with `own`, its block."""
    df = df.withColumn("own", _block(members, block, node)).withColumn("other", F.explode(F.sequence(F.lit(0), (F.ceil(members / float(block)) - 1).cast("int"))))
    return df.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).drop("other")


def families(sketch: np.ndarray, least: int) -> np.ndarray:
    """For each row the first row of its family: rows that chains of pairs with `least` equal bytes connect.

    Each row is compared only with those that no family has yet, so that a family costs little more than its size.
    """
    first, rest = np.full(len(sketch), -1), np.arange(len(sketch))
    for s in range(len(sketch)):
        if first[s] >= 0:
            continue
        first[s], todo, rest = s, [s], rest[rest > s]
        while todo and len(rest):
            near = (sketch[rest] == sketch[todo.pop()]).sum(1) >= least
            first[rest[near]] = s
            todo.extend(rest[near])
            rest = rest[~near]
    return first


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Families inside buckets: an edge from each class to the least class of its family.

    A pair of two blocks puts out edges between families of the blocks only, as members have theirs from their own block.
    """
    for table in grouped(batches, ["key", "p", "q"], 20_000):
        start = np.flatnonzero(changes(table, ["key", "p", "q"]))
        cls = np.array(table.column("cls").to_pylist(), object)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(cls), -1)
        own = table.column("own").to_numpy()
        least = math.ceil(SKETCH_LIMIT * sketch.shape[1])
        across = (table.column("p").to_numpy() != table.column("q").to_numpy())[start]
        size = np.diff(np.append(start, len(cls)))
        a, b = [], []
        group = np.repeat(np.arange(len(start)), size)
        small = (size <= 24) & ~across
        rest = np.flatnonzero(small[group])
        for shift in range(1, int(size[small].max(initial=1))):
            i = rest[: -shift]
            i = i[(i + shift < len(cls))]
            i = i[group[i] == group[i + shift]]
            if not len(i):
                break
            i = i[(sketch[i] == sketch[i + shift]).sum(1) >= least]
            a.append(i)
            b.append(i + shift)
        for g in np.flatnonzero(~small):
            at = np.arange(start[g], start[g] + size[g])
            if not across[g]:
                a.append(at)
                b.append(at[families(sketch[at], least)])
                continue
            left, right = at[own[at] == own[at[0]]], at[own[at] != own[at[0]]]
            home = [x[families(sketch[x], least)] for x in (left, right)]
            for k in range(0, len(left), 32):
                i, j = np.nonzero((sketch[left[k : k + 32], None] == sketch[None, right]).sum(2) >= least)
                a.append(home[0][k : k + 32][i])
                b.append(home[1][j])
        a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (a, b))
        root = components(len(cls), a, b)  # rows of a group are in order of cls, so that the first is the least
        out = np.flatnonzero(root != np.arange(len(cls)))
        yield pa.RecordBatch.from_arrays([pa.array(cls[out], pa.binary()), pa.array(cls[root[out]], pa.binary())], ["a", "b"])


def _set_links(size: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["family", "p", "q"], 256):
            start = np.flatnonzero(changes(table, ["family", "p", "q"]))
            for at, to in zip(start, np.append(start[1:], table.num_rows), strict=True):
                yield _links_of(table.slice(at, to - at).combine_chunks(), size, threshold)

    return run


def _links_of(group: pa.Table, size: int, threshold: float) -> pa.RecordBatch:
    """Links inside one block, or between two: for each class the documents linked to it, and an edge (a, b).

    Inside a block the edge leads from the class to the least one that links connect it with. Between blocks it
    leads from the class's least one in its own block, `home`, to the least of those that the two blocks connect.
    """
    cls, first = np.unique(np.array(group.column("cls").to_pylist(), object), return_index=True)
    group = group.take(first)
    grams, at = ngram_hashes(*word_hashes(*joined_bytes(pa.concat_arrays(group.column("text").chunks))), size)
    copies, own = group.column("copies").to_numpy(), group.column("own").to_numpy()
    sets = [np.unique(grams[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    counts = np.array([len(s) for s in sets], np.float64)
    same = group.column("p")[0].as_py() == group.column("q")[0].as_py()
    left = np.arange(len(cls)) if same else np.flatnonzero(own == own.min())
    right = left if same else np.flatnonzero(own != own.min())
    links, root, home = np.zeros(len(cls), np.int64), np.arange(len(cls)), cls
    if not same:
        home, place = np.unique(np.array(group.column("home").to_pylist(), object), return_inverse=True)
        root = np.arange(len(home))
    if len(left) and len(right):
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(cls)), [len(s) for s in sets])
        shared = times[column] > 1
        row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(left), len(right)), np.float32)
        for k in range(0, int(column.max(initial=-1)) + 1, 4_096):  # a slab of n-grams at a time
            a, b = np.searchsorted(column, [k, k + 4_096])
            slab = np.zeros((len(cls), 4_096), np.float32)
            slab[row[a:b], column[a:b] - k] = 1
            common += slab[left] @ slab[right].T
        linked = common >= threshold * (counts[left][:, None] + counts[right][None] - common) - 1e-9
        if same:
            np.fill_diagonal(linked, False)
        i, j = np.nonzero(linked)
        np.add.at(links, left[i], copies[right[j]])
        if same:
            root = components(len(cls), i, j)
        else:
            np.add.at(links, right[j], copies[left[i]])
            root = components(len(home), place[left[i]], place[right[j]])
    if same:
        return pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(links), pa.array(cls, pa.binary()), pa.array(cls[root], pa.binary())], ["cls", "links", "a", "b"])
    return pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(links), pa.array(home[place], pa.binary()), pa.array(home[root[place]], pa.binary())], ["cls", "links", "a", "b"])


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): the least node of its component.

    Labels move along edges and are then looked up at each other, so that chains shrink by halves; each round
    is a table in the shared folder. Only a count of changes comes to the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root"), "labels")
    while True:
        far = labels.select(F.col("node").alias("b"), F.col("root").alias("far"))
        own = labels.select(F.col("node").alias("a"), F.col("root").alias("old"))
        # the label of a node is among those it is compared with, as an edge to itself
        rows = small_join(both, far, ["b"], "inner").select("a", "far", F.lit(None).cast("binary").alias("old")).unionByName(own.select("a", F.col("old").alias("far"), "old"))
        step = rows.groupBy("a").agg(F.min("far").alias("least"), F.max("old").alias("old"))
        jump = labels.select(F.col("node").alias("least"), F.col("root").alias("beyond"))
        step = small_join(step, jump, ["least"], "left").select(F.col("a").alias("node"), "old", F.least("least", F.coalesce("beyond", "least")).alias("root"))
        step = materialize(step, "labels")
        labels = step.select("node", "root")
        if step.filter("root <> old").isEmpty():
            return labels


def _linked(rows: DataFrame, size: int, threshold: float) -> DataFrame:
    rows = rows.select("family", "p", "q", "own", "cls", "home", "copies", "text").repartition("family", "p", "q").sortWithinPartitions("family", "p", "q")
    return rows.mapInArrow(_set_links(size, threshold), "cls binary, links long, a binary, b binary")


def ngram_links(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, cls, class_id, root, n_links) of every row of docs.

    Words are runs between ASCII white space, taken as they are; two rows are linked if the Jaccard
    coefficient of their sets of `size`-word n-grams is at least threshold (a text of fewer words has one
    n-gram of them all). n_links counts the other rows a row is linked to, copies included. class_id is the
    least doc_id among the rows that links connect it with, itself included (null: none of them has an id);
    cls is the MD5 of the text, and root the least cls among those rows: it tells classes apart where ids are null
    or repeated. Rows without words, null texts included, have no links and are classes by
    themselves. Repeated rows are copies of each other; other columns of docs are ignored; an empty table
    gives an empty result. A pair at the threshold is found with probability `recall`, a closer one with more.
    """
    bands, rows = bands_for(threshold, recall, MOST_HASHES)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), class_key(docs["text"]).alias("cls"), docs["text"].cast("string").alias("text"))
    marks = materialize(texts.mapInArrow(_signatures(size, bands, rows), "doc_id long, cls binary, bands array<long>, sketch binary"), "signatures")
    classes = marks.filter("sketch is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = materialize(classes, "classes")

    keys = classes.select("cls", F.explode("bands").alias("key"))
    # counts by key are tables, so that Spark can split the keys that are hot in the joins with them
    often = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "often")
    buckets = block_pairs(keys.join(often, "key").join(classes.select("cls", "sketch"), "cls"), F.col("members"), BUCKET_BLOCK)
    buckets = buckets.select("key", "p", "q", "own", "cls", "sketch").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "cls")
    family = connected(buckets.mapInArrow(_bucket_edges, "a binary, b binary"))

    sizes = materialize(family.groupBy("root").agg(F.count(F.lit(1)).alias("members")), "sizes")
    families = family.join(sizes, "root").join(classes.select(F.col("cls").alias("node"), "copies", "first_id"), "node")
    families = families.select(F.col("node").alias("cls"), F.col("root").alias("family"), "members", "copies", "first_id")
    # one row of each class: copies that share their id too are told apart by nothing, and one of them is used
    wanted = materialize(families.withColumn("at", F.coalesce("first_id", F.lit(-(1 << 63)))).drop("first_id"), "families")
    found = texts.withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63)))).drop("doc_id")
    found = only_keys(found, wanted, ["cls", "at"]).join(wanted, ["cls", "at"])
    found = materialize(found.select("family", "members", "cls", "copies", "text"), "candidates")
    alone = found.withColumn("own", _block(F.col("members"), FAMILY_BLOCK)).withColumns({"p": F.col("own"), "q": F.col("own"), "home": F.lit(None).cast("binary")})
    linked = materialize(_linked(alone, size, threshold), "links")
    wide = found.filter(F.col("members") > FAMILY_BLOCK)
    if not wide.isEmpty():
        homes = linked.select("cls", F.col("b").alias("home"))
        pairs = block_pairs(wide.join(homes, "cls"), F.col("members"), FAMILY_BLOCK).filter("p <> q")
        linked = linked.unionByName(materialize(_linked(pairs, size, threshold), "links"))

    roots = connected(linked.filter("a <> b").select("a", "b"))
    links = linked.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = classes.select("cls", "copies", "first_id").join(links, "cls", "left").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
    groups = materialize(groups.select("cls", "copies", "first_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cls").alias("root")), "groups")
    ids = groups.groupBy("root").agg(F.min("first_id").alias("class_id"))
    groups = groups.join(ids, "root").select("cls", "root", "copies", "links", "class_id", F.lit(True).alias("__has"))
    out = marks.select("doc_id", "cls").join(groups, "cls", "left")
    return out.select("doc_id", "cls", F.when(F.col("__has"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("root", "cls").alias("root"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs with one row of each class of linked rows, that with the least (doc_id, MD5 of the text), null ids last; others as they are.

    A row without words has no links and stays. Rows equal in every column are copies: one of them stays. The
    choice is a minimum by group, combined before it is shuffled; texts are not moved to make it.
    """
    links = ngram_links(docs, size, threshold, recall).filter("n_links > 0")
    first = links.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "cls")).alias("stays"))
    gone = links.join(first, "root").filter((F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)) != F.col("stays.doc_id")) | (F.col("cls") != F.col("stays.cls")))
    gone = gone.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "cls").distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")  # columns may have any names
    rows = docs.select(whole, F.coalesce(docs["doc_id"], F.lit((1 << 63) - 1)).alias("id"), class_key(docs["text"]).alias("cls")).join(gone, ["id", "cls"], "left_anti")
    # copies that share their id as well
    again = links.groupBy("doc_id", "cls").count().filter("count > 1").select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "cls")
    same = materialize(again, "same")
    if same.isEmpty():
        return rows.select("doc.*")
    alone = rows.join(same, ["id", "cls"], "left_anti")
    return alone.unionByName(rows.join(same, ["id", "cls"], "left_semi").dropDuplicates(["id", "cls"])).select("doc.*")
