"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every row draws an exponential key, -ln(u) / quality weight, with u from a hash of its id. Sorted by that
key within its source, rows are taken until the words before them fill the source's token budget. Budgets
above one pass take complete epochs first and sample only the fraction. All of it is DataFrame expressions.

A source may hold a third of all rows, so no source is ever sorted as a whole: keys fall into bins, bins are
summed, and only the bin in which the budget ends is cut into finer bins, whose last one is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, word_count

#: Weights of the sources in their order, repeating; words of the mix as a share of all words; passes at most.
WEIGHTS, SHARE, MAX_EPOCHS, BINS, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 512, "mix"
#: Quality weight of a row: labelled good, labelled poor, unlabelled.
GOOD, POOR, UNKNOWN = 2.0, 0.5, 1.0


def draw(id_col: Column, text: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from id and text: 52 bits of an MD5, the same in every run and every engine."""
    whole = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f"|{seed}|"), F.md5(F.coalesce(text, F.lit(""))))
    bits = F.conv(F.substring(F.md5(whole), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight), one row for each labelled id; several labels of an id count as poor if one is."""
    rows = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return rows.select(F.col("doc_id").alias("weight_id"), F.when(F.col("quality") > 0, GOOD).otherwise(POOR).alias("weight"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources share share * (all words) by weight. A target stops at max_epochs times its source's size, and
    what exceeds it goes to the others by weight, until none is above: sorted by limit / weight, those before
    a place in the order are at their limits, the others get one level times their weight. Sources number far
    fewer than rows, so their windows may run in one task.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    x = sizes.select("source", "source_size", place.alias("place"))
    x = x.select("source", "source_size", "place", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")).alias("w"), (F.col("source_size") * float(max_epochs)).alias("most"))
    order = W.orderBy(F.col("most") / F.col("w"), "place")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy()) * float(share)
    x = x.select("*", ((total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)).alias("level"))
    # the first place whose own limit is not below its level; all after it get that level too
    fits = F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("level"))
    x = x.select("*", F.first(fits, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("own"))
    return x.select("source", "source_size", F.coalesce(F.col("own") * F.col("w"), F.col("most")).alias("target"))


def source_tag() -> Column:
    """The source as a join key without null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))


def keyed(docs: DataFrame, labels: DataFrame | None, seed: str = SEED) -> DataFrame:
    """__doc (all columns of docs), doc_id, source, __s, __size, __key and __bin: the sampling key, and 1 - exp(-key), which grows with it in [0, 1]."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), "doc_id", "source", source_tag().alias("__s"), word_count(docs["text"]).alias("__size"), draw(docs["doc_id"], docs["text"], seed).alias("__u"))
    if labels is None:
        rows = rows.withColumn("__w", F.lit(UNKNOWN))
    else:
        marks = quality_weights(labels).select(F.col("weight_id").alias("__id"), F.col("weight").alias("__weight"))
        rows = rows.join(marks, rows["doc_id"] == marks["__id"], "left").withColumn("__w", F.coalesce("__weight", F.lit(UNKNOWN))).drop("__id", "__weight")
    rows = rows.withColumn("__key", -F.log("__u") / F.col("__w"))
    return rows.withColumn("__bin", 1 - F.exp(-F.col("__key"))).drop("__w", "__u")


def _end_bin(rows: DataFrame, bins: DataFrame, bin_col: Column) -> DataFrame:
    """For each source of `bins` (__s, room): the bin in which its room ends (n, null: none), and what is left there."""
    sums = rows.groupBy("__s", bin_col.alias("n")).agg(F.sum("__size").alias("words"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("__s").orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("__s", "n", "words", before.alias("before")).join(bins, "__s")
    end = sums.filter(F.col("before") + F.col("words") > F.col("room")).groupBy("__s").agg(F.min_by(F.struct("n", (F.col("room") - F.col("before")).alias("room")), "n").alias("end"))
    return end.select("__s", F.col("end.n").alias("n"), F.col("end.room").alias("room"))


def mix_plan(rows: DataFrame, targets: DataFrame, bins: int = BINS) -> DataFrame:
    """One row for each source: targets, epochs, and the place in the order of keys up to which it is sampled.

    rows: (__s, __size, __key, __bin, doc_id), where __s is the source with null made a value of its own.
    """
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("epochs", epochs).withColumn("room", F.col("target") - F.col("epochs") * F.col("source_size"))
    first = F.floor(F.col("__bin") * bins).cast("int")
    second = F.floor((F.col("__bin") * bins - first) * bins).cast("int")
    one = materialize(_end_bin(rows, plan.select("__s", "room"), first), "mix-bins")
    inner = rows.join(one.select("__s", F.col("n").alias("n1"), F.col("room")), "__s").filter(first == F.col("n1"))
    inner = materialize(inner.select("__s", "__size", "__key", "__bin", "doc_id", "room"), "mix-last")
    two = materialize(_end_bin(inner.drop("room"), one.select("__s", "room"), second), "mix-bins")
    last = inner.drop("room").join(two.select("__s", F.col("n").alias("n2"), "room"), "__s").filter(second == F.col("n2"))
    order = W.partitionBy("__s").orderBy("__key", F.col("doc_id").asc_nulls_first(), "__size").rowsBetween(W.unboundedPreceding, -1)
    last = last.withColumn("before", F.coalesce(F.sum("__size").over(order), F.lit(0)))
    # a row is taken if the room ends past its middle, so that the sum comes as near the target as whole rows allow
    last = materialize(last.select("__s", "room", "before", "__size", _place().alias("at")), "mix-order")
    cut = last.filter(F.col("before") + F.col("__size") / 2 <= F.col("room")).groupBy("__s").agg(F.max("at").alias("cut"))
    # rows that agree in key, id and size are copies: so many of them as fit are taken
    ends = last.join(cut, "__s").filter(F.col("at") == F.col("cut")).groupBy("__s").agg(F.first("cut").alias("cut"), F.count(F.lit(1)).alias("copies"), F.count_if(F.col("before") + F.col("__size") / 2 <= F.col("room")).alias("taken"))
    one, two = one.select("__s", F.col("n").alias("n1")), two.select("__s", F.col("n").alias("n2"))
    plan = plan.join(one, "__s", "left").join(two, "__s", "left").join(ends, "__s", "left")
    return materialize(plan.select("__s", F.struct(*[c for c in plan.columns if c != "__s"]).alias("__plan")), "mix-plan")


def _place() -> Column:
    return F.struct(F.col("__key").alias("key"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("doc_id"), F.col("__size").alias("size"))


def _is_sampled(bins: int) -> Column:
    first = F.floor(F.col("__bin") * bins).cast("int")
    second = F.floor((F.col("__bin") * bins - first) * bins).cast("int")
    p, at = F.col("__plan"), _place()
    inside = F.coalesce((at < p["cut"]) | ((at == p["cut"]) & (F.col("__nth") <= p["taken"])), F.lit(False))
    inside = p["n2"].isNull() | (second < p["n2"]) | ((second == p["n2"]) & inside)
    return p["n1"].isNull() | (first < p["n1"]) | ((first == p["n1"]) & inside)


def _numbered(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows joined with the plan, and with __nth: among copies of which only some are taken, the number of the row, else 0.

    Such copies are numbered within their partitions, after the counts of the partitions before, so that no task
    gathers them; which of them are taken makes no difference to the mix.
    """
    rows = rows.join(plan, "__s")
    if plan.filter("__plan.taken < __plan.copies").isEmpty():
        return rows.withColumn("__nth", F.lit(0).cast("long"))
    tied = F.coalesce((F.col("__plan.taken") < F.col("__plan.copies")) & (_place() == F.col("__plan.cut")), F.lit(False))
    some = materialize(rows.filter(tied).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), "mix-copies")
    before = F.coalesce(F.sum("n").over(W.partitionBy("__s").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = some.groupBy("__s", "__part").agg(F.count(F.lit(1)).alias("n")).select("__s", "__part", before.alias("__before"))
    some = some.withColumn("__own", F.row_number().over(W.partitionBy("__s", "__part").orderBy("__row"))).join(parts, ["__s", "__part"])
    some = some.withColumn("__nth", (F.col("__own") + F.col("__before")).cast("long")).drop("__part", "__row", "__own", "__before")
    return rows.filter(~tied).withColumn("__nth", F.lit(0).cast("long")).unionByName(some)


def _planned(docs: DataFrame, labels: DataFrame | None, weights: tuple[float, ...], share: float, max_epochs: float, bins: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """The measured rows (doc_id, source and sampling columns, no text), and the plan of each source."""
    measured = keyed(docs.select("doc_id", "text", "source"), labels, seed).select("doc_id", "source", "__s", "__size", "__key", "__bin")
    measured = materialize(measured, "mix-sizes")
    sizes = measured.groupBy("source").agg(F.sum("__size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, share, max_epochs).withColumn("__s", source_tag()).drop("source"), "mix-targets")
    return measured, mix_plan(measured.drop("source"), targets, bins)


def _taken(rows: DataFrame, plan: DataFrame, columns: list[Column], bins: int) -> DataFrame:
    rows, p = _numbered(rows, plan), F.col("__plan")
    repeats = p["epochs"] + F.when(_is_sampled(bins), 1).otherwise(0)
    return rows.select(*columns, F.col("__size").alias("size"), p["source_size"].alias("source_size"), p["target"].alias("target"), (F.col("__size") * repeats).alias("taken"), repeats.alias("repeats"))


def mix_sources(docs: DataFrame, labels: DataFrame | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, bins: int = BINS, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, taken (words the mix takes of the row) and repeats.

    Sources in order of their code points, null last, get `weights` in turn. taken is size * repeats; repeats
    is the number of complete epochs plus one for a sampled row. A null text has size 0; a null source is a
    source; rows draw by id and text, null ids too. Rows that agree in both are copies: of those at the end of
    the budget as many are taken as fit, any of them. A source of size 0 has target 0 and keeps its rows once. An
    empty table gives an empty result. docs needs doc_id, text and source; its other columns come back, whatever
    their names, but for those that have one of the five names above.
    """
    docs = docs.drop("size", "source_size", "target", "taken", "repeats")
    _, plan = _planned(docs, labels, weights, share, max_epochs, bins, seed)
    return _taken(keyed(docs, labels, seed), plan, [F.col(f"__doc.`{c}`") for c in docs.columns], bins)


def mix_figures(docs: DataFrame, labels: DataFrame | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, bins: int = BINS, seed: str = SEED) -> DataFrame:
    """mix_sources() without the texts: doc_id, source and the five figures, from one pass over the texts."""
    measured, plan = _planned(docs, labels, weights, share, max_epochs, bins, seed)
    return _taken(measured, plan, [F.col("doc_id"), F.col("source")], bins)


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as the mix takes it, without the figures."""
    columns = [F.col(f"`{c}`") for c in mixed.columns if c not in ("size", "source_size", "target", "taken", "repeats")]
    return mixed.filter("repeats > 0").select(F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))), F.struct(*columns).alias("__doc")).select("__doc.*")
