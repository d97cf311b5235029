"""A prefix trie of conversations by partition refinement.

All conversations begin in one class, the root. A round splits the classes that are still active by the next
turns of their members; rounds take 1, 1, 2, 4 ... turns, so that a shared prefix of n turns takes about log n
rounds. A class's name is a digest of its parent's name and its turn, so that a split needs no join by class:
members are counted by name, combined before the shuffle. A conversation that is alone in its class retires
with its parent's name; its tail is a chain of nodes with one child each, put out at the end. What nodes save
and the leaves there are fold back along the path of a node's smallest member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, ranked, small_join, union_all, word_count

#: The most turns that a round reads of a conversation; ids that a chunk of a node's ends covers.
MOST_TURNS, ENDS = 1_024, 4_096


def root_name() -> Column:
    return F.unhex(F.lit(""))


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, words, total) of every turn: its place from 0 in its conversation, and the conversation's turns."""
    d = conversations
    role, text = (F.coalesce(d[c].cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = d.filter(d["conv_id"].isNotNull()).select(d["conv_id"].cast("long").alias("conv_id"), d["turn"].alias("turn"), role.alias("role"), digest.alias("digest"), word_count(text).alias("words"))
    return ranked(materialize(rows, "turns"), ["conv_id"], ["turn", "role", "digest"]).select("conv_id", "place", "digest", "words", "total")


def rebuild(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos from 1, digest, words) and conversations (conv_id, len), with the first h turns of a group's first conversation in place of each one's own.

    h is the crc32 of the id modulo `most`; fewer turns take their place if the first conversation has fewer, none if
    it is absent. At most 2 * group - 1 conversations share a first one.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = turns.groupBy("conv_id").agg(F.max("total").alias("own")).withColumns({"h": head, "base": F.col("conv_id") - F.col("conv_id") % group})
    bases = convs.filter("conv_id = base").select("base", F.col("own").alias("base_own"))
    convs = convs.join(bases, "base", "left").withColumn("b", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = materialize(convs.select("conv_id", "base", "h", "b", (F.greatest(F.col("own") - F.col("h"), F.lit(0)) + F.col("b")).alias("len")), "convs")
    firsts = turns.filter((F.col("conv_id") % group == 0) & (F.col("place") < most - 1)).select(F.col("conv_id").alias("base"), "place", "digest", "words")
    heads = firsts.join(convs.filter("b > 0"), "base").filter("place < b").select("conv_id", (F.col("place") + 1).alias("pos"), "digest", "words")
    own = small_join(turns, convs, ["conv_id"], "inner").filter("place >= h")
    tails = own.select("conv_id", (F.col("place") - F.col("h") + F.col("b") + 1).alias("pos"), "digest", "words")
    return materialize(heads.unionByName(tails), "rebuilt"), convs.select("conv_id", "len")


def refine(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Splits classes until every conversation has ended or is alone. Tables of the rounds:

    steps (conv_id, depth, cls): the classes that conversations pass, where more than one member is;
    classes (cls, parent, depth, words, n_convs, conv_id): of these, conv_id is the smallest member;
    alone (conv_id, depth, parent, len): conversations that retire, at the depth at which they are alone;
    ends (cls, conv_id): conversations that end within a class.
    """
    active = convs.select("conv_id", "len", root_name().alias("cls"))
    steps = [active.select("conv_id", F.lit(0).cast("long").alias("depth"), "cls")]
    root = active.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    classes = [root.select(root_name().alias("cls"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "n_convs", "conv_id")]
    alone, ends, depth, count = [], [active.filter("len = 0").select("cls", "conv_id")], 0, 1
    while not (live := active.filter(F.col("len") > depth)).isEmpty():
        upto = depth + count
        next_turns = turns.filter((F.col("pos") > depth) & (F.col("pos") <= upto)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("next"))
        rows = live.join(next_turns, "conv_id")
        link = lambda names, turn: F.concat(names, F.array(F.unhex(F.sha2(F.concat(F.element_at(names, -1), turn["digest"]), 256))))
        rows = rows.withColumn("names", F.aggregate("next", F.array("cls"), link))
        step = F.explode(F.transform("next", lambda t, k: F.struct(t["pos"].alias("depth"), F.get("names", k).alias("parent"), F.get("names", k + 1).alias("cls"), t["words"].alias("words"))))
        split = materialize(rows.select("conv_id", "len", step.alias("s")).select("conv_id", "len", "s.*"), "split")
        found = split.groupBy("cls").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("len").alias("len"))
        found = materialize(found, "classes")
        classes.append(found.filter("n_convs > 1").drop("len"))
        retired = found.filter("n_convs = 1").groupBy("conv_id").agg(F.min_by(F.struct("depth", "parent", "len"), "depth").alias("r"))
        retired = materialize(retired.select("conv_id", "r.*"), "retired")
        alone.append(retired)
        # conversations are alone from one depth on; both sides have a conversation once, or once for each turn of the round
        shared = split.join(retired.select("conv_id", F.col("depth").alias("until")), "conv_id", "left").filter("until is null or depth < until")
        shared = materialize(shared.select("conv_id", "len", "depth", "cls"), "shared")
        steps.append(shared.select("conv_id", "depth", "cls"))
        ends.append(shared.filter("depth = len").select("cls", "conv_id"))
        active, depth, count = shared.filter(F.col("depth") == upto).select("conv_id", "len", "cls"), upto, min(MOST_TURNS, upto)
    none = convs.select("conv_id", F.lit(1).cast("long").alias("depth"), root_name().alias("parent"), "len").limit(0)
    return union_all(steps), materialize(union_all(classes), "nodes"), union_all(alone) if alone else none, union_all(ends)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by class and block, to the SHA-256 of each class's chunks, joined by commas; holds one state."""
    name, state = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for cls, chunk in zip(batch.column("cls").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
            if cls != name:
                if state is not None:
                    done.append((name, state.hexdigest()))
                name, state = cls, hashlib.sha256(chunk.encode())
            else:
                state.update(f",{chunk}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["cls", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()])], ["cls", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(cls, ends_sha256): of the ascending ids, joined by commas, of the conversations that end in a class.

    Ids are joined in chunks of ENDS possible ids, so that a class in which very many end is many chunks; a digest
    needs them in order, so one task reads a class's chunks one after the other, and holds none of them.
    """
    chunks = ends.groupBy("cls", F.floor(F.col("conv_id") / F.lit(float(ENDS))).alias("block")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    chunks = chunks.select("cls", "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("chunk"))
    return chunks.repartition("cls").sortWithinPartitions("cls", "block").mapInArrow(_hashed, "cls binary, ends_sha256 string")


def fold_back(steps: DataFrame, classes: DataFrame, alone: DataFrame) -> DataFrame:
    """(cls, n_leaves, saved_tokens): sums over the subtree.

    A class puts what it saves, and 1 if it has no child, on its smallest member at its depth; a conversation that
    is alone puts a leaf on itself. Sums along a conversation from its end give what lies below each class that
    it passes, and these add up by class, combined before the shuffle.
    """
    parents = classes.select("parent").union(alone.select("parent")).filter("parent is not null").distinct().withColumn("has", F.lit(True))
    own = classes.join(parents.withColumnRenamed("parent", "cls"), "cls", "left")
    own = own.select("conv_id", "depth", F.when(F.col("has"), 0).otherwise(1).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    single = alone.select("conv_id", (F.col("depth") - 1).alias("depth"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    items = own.unionByName(single).groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    items = materialize(items, "items")
    passed = steps.join(items, ["conv_id", "depth"], "left")
    below = W.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    sums = passed.select("cls", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(c) for c in ("leaves", "saved")])
    return sums.groupBy("cls").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first; ties by role, then by the digest of role and text; equal turns all count.
    Null roles and texts are empty. Rows without conv_id belong to no conversation and are left out; an empty
    table has no node. Other columns don't matter. Texts leave the first scan as digests only. A conversation
    may have any number of turns, and any number may share a prefix: no task holds either. Only the chain of
    a retired conversation is put out by the task that has its row, in pieces.
    """
    turns, convs = rebuild(turn_rows(conversations))
    if convs.isEmpty():
        return convs.select("conv_id", *[F.lit(None).cast("long").alias(c) for c in ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], F.lit(None).cast("string").alias("ends_sha256"))
    steps, classes, alone, ends = refine(turns, convs)
    alone = materialize(alone, "alone")
    nothing = F.sha2(F.lit(""), 256)
    children = classes.select("parent").union(alone.select("parent")).filter("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    whole = classes.join(fold_back(steps, classes, alone), "cls").join(children.withColumnRenamed("parent", "cls"), "cls", "left").join(end_digests(ends), "cls", "left")
    smallest = materialize(classes.select(F.col("cls").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "smallest")
    shared = small_join(whole, smallest, ["parent"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))

    heads = small_join(alone, smallest, ["parent"], "inner")
    pieces = heads.withColumn("piece", F.explode(F.sequence("depth", "len", F.lit(MOST_TURNS).cast("long"))))
    chain = pieces.withColumn("at", F.explode(F.sequence("piece", F.least(F.col("piece") + MOST_TURNS - 1, F.col("len")))))
    last = F.col("at") == F.col("len")
    one = F.lit(1).cast("long")
    parent = F.when(F.col("at") == F.col("depth"), F.col("parent_conv_id")).otherwise(F.col("conv_id"))
    tails = chain.select("conv_id", F.col("at").alias("depth"), parent.alias("parent_conv_id"), one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"))
    return shared.unionByName(tails)
