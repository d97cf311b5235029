"""Merkle manifest of a table: hash trees over ordered leaves, collapsed block by block in higher-order functions.

A block is a row with an ordered array of at most BLOCK nodes. transform() and slice() make one level from the
level before it, aggregate() over a sequence() of levels makes all of a block's. Block roots are the nodes of
the next pass, until a tree has one block. Paths come down the same way, from block roots to their members.
Everything is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranked

#: Nodes that share a parent, levels that a full block collapses, and its nodes.
ARITY, LEVELS = 8, 3
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A field of a leaf: "-" if null, else its UTF-8 bytes' number, ":" and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def level_above(level: Column) -> Column:
    """The digests of runs of ARITY nodes, the last run with what is left."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(level) / F.lit(float(ARITY))).cast("int") - 1)
    return F.transform(runs, lambda r: digest(F.array_join(F.slice(level, r * ARITY + 1, ARITY), "")))


def collapse(nodes: Column, height: Column) -> Column:
    """A block's levels: its nodes, and `height` levels above them."""
    steps = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(nodes), lambda levels, _: F.concat(levels, F.array(level_above(F.element_at(levels, -1)))))


def path_within(levels: Column, at: Column) -> Column:
    """For node `at` of a block and each level but the top: the siblings on the left and on the right, each joined."""
    units = F.slice(F.array(*[F.lit(ARITY**k) for k in range(LEVELS)]), F.lit(1), F.size(levels) - 1)

    def step(unit: Column, k: Column) -> Column:
        level, own = F.get(levels, k), F.floor(at / unit).cast("int")
        first = (own - own % ARITY).cast("int")
        left = F.array_join(F.slice(level, first + 1, own - first), "")
        right = F.array_join(F.slice(level, own + 2, first + ARITY - own - 1), "")
        return F.struct(left.alias("left"), right.alias("right"))

    return F.transform(units, step)


def fold(node: Column, path: Column) -> Column:
    """The root that a node and its path give."""
    return F.aggregate(path, node, lambda acc, p: digest(F.concat(p["left"], acc, p["right"])))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""))


def grow(nodes: DataFrame, tree: list[str], payload: list[str]) -> list[DataFrame]:
    """The blocks of each pass, the last one with one block for each tree; none for an empty table.

    nodes has the columns of `tree`, `place` (a node's number in its tree), `total` (the tree's nodes), `node` and
    the payload. A pass shuffles its nodes once, to blocks of BLOCK at most, so that no tree is one task's.
    """
    passes: list[DataFrame] = []
    while True:
        member = F.struct("place", "node", *payload)
        rows = nodes.groupBy(*tree, F.floor(F.col("place") / BLOCK).alias("block")).agg(F.max("total").alias("total"), F.array_sort(F.collect_list(member)).alias("members"))
        height = sum(((F.col("total") > ARITY**k).cast("int") for k in range(LEVELS)), F.lit(0))
        rows = rows.withColumn("levels", collapse(F.transform("members", lambda m: m["node"]), height)).withColumn("root", F.get(F.element_at("levels", -1), F.lit(0)))
        blocks = materialize(rows, "blocks")
        most = blocks.agg(F.max("total")).first()[0]
        if most is None:
            return passes
        passes.append(blocks)
        if most <= BLOCK:
            return passes
        nodes, payload = blocks.select(*tree, F.col("block").alias("place"), F.ceil(F.col("total") / BLOCK).alias("total"), F.col("root").alias("node")), []


def descend(passes: list[DataFrame], tree: list[str], above: DataFrame, carry: list[str]) -> DataFrame:
    """The lowest blocks with `path`, from a block's root up to the top; above has the path and `carry` for each tree."""
    paths = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(passes[1:]):
        rows = blocks.join(paths, [*tree, "block"])
        rows = rows.withColumn("member", F.explode(F.transform("members", lambda m, i: F.struct(m["place"].alias("block"), path_within(F.col("levels"), i).alias("own")))))  # noqa: B023
        paths = rows.select(*tree, F.col("member.block").alias("block"), F.concat("member.own", "path").alias("path"), *carry)
    return passes[0].join(paths, [*tree, "block"])


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", order: str = "doc_id", tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(id, leaf, subroot, root, path, tampered) of every row; id is the row's `order`.

    A leaf is the digest of the fields. Rows with one value of `tree` (null is a value) form a tree, ordered by
    `order` (null first); ties are ordered by their leaf, equal rows are leaves of their own. The roots of trees,
    ordered by the tree's value (null first, by bytes), are the leaves of the tree above them. A tree of one leaf
    is that leaf. path has (left, right) siblings for each level, from the leaf to the root. `tampered` is the
    leaf with the columns of that argument put in, for rows for which `where` holds, else null. Other columns
    of docs don't matter, whatever their names. An empty table gives an empty result. Texts pass one digest each
    and are not shuffled.
    """
    value = lambda c: (tampered or {}).get(c, docs[f"`{c}`"])
    leaf, other = leaf_of([docs[f"`{c}`"] for c in fields]), F.lit(None).cast("string")
    if tampered:
        other = F.when(F.coalesce(where if where is not None else F.lit(True), F.lit(False)), leaf_of([value(c) for c in fields]))
    key = F.coalesce(F.concat(F.lit("="), docs[f"`{tree}`"].cast("string")), F.lit(""))  # keeps the order, null first
    leaves = materialize(docs.select(key.alias("tree"), docs[f"`{order}`"].alias("id"), leaf.alias("node"), other.alias("tampered")), "leaves")
    passes = grow(ranked(leaves, ["tree"], ["id", "node"]), ["tree"], ["id", "tampered"])
    if not passes:
        return leaves.select("id", F.col("node").alias("leaf"), F.col("node").alias("subroot"), F.col("node").alias("root"), F.lit(None).cast("array<struct<left:string,right:string>>").alias("path"), "tampered")

    subroots = passes[-1].select("tree", F.col("root").alias("node"))
    upper = grow(ranked(subroots, [], ["tree"]), [], ["tree"])
    top = upper[-1].select(F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("root").alias("top"))
    trees = descend(upper, [], top, ["top"])
    trees = trees.withColumn("member", F.explode(F.transform("members", lambda m, i: F.struct(m["tree"].alias("tree"), m["node"].alias("subroot"), path_within(F.col("levels"), i).alias("own")))))
    above = trees.select("member.tree", "member.subroot", F.concat("member.own", "path").alias("path"), "top")
    rows = descend(passes, ["tree"], above, ["subroot", "top"])
    rows = rows.withColumn("member", F.explode(F.transform("members", lambda m, i: F.struct(m["id"].alias("id"), m["node"].alias("leaf"), m["tampered"].alias("tampered"), path_within(F.col("levels"), i).alias("own")))))
    return rows.select("member.id", "member.leaf", "subroot", F.col("top").alias("root"), F.concat("member.own", "path").alias("path"), "member.tampered")


def verify(rows: DataFrame) -> DataFrame:
    """manifest()'s rows with `folded_root`, from the tampered leaf if there is one, and `verified`."""
    rows = rows.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def merkle_digests(docs: DataFrame) -> DataFrame:
    """One row for each of docs; texts are lower-cased in rows whose id's crc32 is divisible by 3."""
    third = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0
    rows = manifest(docs, tampered={"text": lower_ascii(docs["text"])}, where=third)
    return verify(rows).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")
