"""Benchmark decontamination by template canonicalisation, in DataFrame expressions only.

Numbers (in digits or words), units after numbers and words with a capital become typed placeholders; what
remains is lower case.
Windows of these tokens, and of the plain words, are joined by their hash with those of the benchmark. Matches
on one diagonal (place in the document less place in the item) are one passage; it counts if the tokens really
agree and its slots are consistent: different numbers or names of the item are different ones in the document,
and one that repeats is one that repeats there. A window of more slots than words counts only as an exact copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, only_keys, small_join

#: Tokens in a window, and windows of a passage that make a leak: 6 windows of 8 cover 13 tokens. Shorter items
#: need all their windows; items of fewer tokens than LEAST are never matched.
WINDOW, HITS, LEAST = 8, 6, 4
#: Windows with a smaller share of plain tokens say too little, unless their numbers and names agree as well.
PLAIN = 0.5
#: Windows of the benchmark that are sent to every executor; a larger benchmark is joined by a shuffle.
BROADCAST = 500_000
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "ton", "tons", "pound", "pounds", "ounce", "ounces", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "degree", "degrees", "mph", "kmh", "watt", "watts", "volt", "volts")
#: Words that are numbers.
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion")
#: Every word of two letters or more that begins with a capital (Alice, McDonald, IBM), whatever stands before it; and
#: those inside a sentence, which are surely names. An apostrophe between capitals is part of a name (O'Neil).
_CAPITAL, _INSIDE = "\\p{Lu}(?<![\\p{L}\\p{N}].)\\p{L}+", "\\p{Lu}(?<=[\\p{Ll},;:] .)\\p{L}+"
_APOSTROPHE, _PRIVATE = "['\u2019](?=\\p{Lu}\\p{Ll})(?<=\\p{Lu}.)", f"[{NUMBER}-{NAME}]"
_CUT = f"[^\\p{{L}}\\p{{N}}{NUMBER}{UNIT}{NAME}]+"


def cleaned(text: Column) -> Column:
    """A text without the placeholders' own characters, and with names like O'Neil in one word; null is empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), _PRIVATE, " "), _APOSTROPHE, "")


def tokens(text: Column, name: str = _CAPITAL) -> tuple[Column, Column]:
    """(plain tokens in lower case, template tokens) of a cleaned text, a column of its own: two arrays of one length."""
    # 1,234.5 is one number, 5kg a number and a unit
    joined = F.regexp_replace(F.regexp_replace(text, "(?<=\\p{N})[.,](?=\\p{N})", ""), "(?<=\\p{N})(?=\\p{L})", " ")
    has = text.rlike("\\p{N}")
    plain = F.when(has, joined).otherwise(text)
    named = F.regexp_replace(plain, name, NAME)
    units = "|".join(UNITS)
    numbers = F.regexp_replace(F.regexp_replace(named, "\\p{N}+", NUMBER), f"(?<={NUMBER} )(?i:{units})(?![\\p{{L}}\\p{{N}}])", UNIT)
    cut = lambda c: F.filter(F.split(F.lower(c), _CUT), lambda x: x != "")
    words = lambda x: F.when(x.isin(*NUMBER_WORDS), NUMBER).otherwise(x)
    return cut(plain), F.transform(cut(F.when(has, numbers).otherwise(named)), words)


def _joined_hashes(codes: Column, step: int) -> Column:
    """The hash of each code and the one `step` places on, in order; none if there is no such pair."""

    def pairs(c: Column) -> Column:
        n = F.greatest(F.size(c) - step, F.lit(0))
        return F.zip_with(F.slice(c, 1, n), F.slice(c, step + 1, n), lambda x, y: F.xxhash64(x, y))

    # a lambda's variable is worked out once; an expression would be for each of its uses
    return F.element_at(F.transform(F.array(codes), pairs), 1)


def window_hashes(template: Column, size: int) -> Column:
    """The hashes of all windows of `size` tokens, in order; none if there are fewer tokens.

    Windows of 2, 4, ... tokens are hashed from two of half their length, the last ones from two that overlap.
    """
    codes, width = F.transform(template, lambda x: F.xxhash64(x)), 1
    while width < size:
        step = min(width, size - width)
        codes, width = _joined_hashes(codes, step), width + step
    return codes


def _all_differ(pairs: Column, side: str) -> Column:
    return F.size(F.array_distinct(F.transform(pairs, lambda p: p[side]))) == F.size(pairs)


def _is_slot(token: Column) -> Column:
    return token.isin(NUMBER, UNIT, NAME)


def _all_windows(column: Column) -> Column:
    """window_hashes() of the size that each item has."""
    by_size = window_hashes(column, WINDOW)
    for size in range(LEAST, WINDOW):
        by_size = F.when(F.col("size") == size, window_hashes(column, size)).otherwise(by_size)
    return by_size


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item, ids, plain, template, inside, size, need, whole, telling, ipos, hashes): a row for each window of each distinct item text.

    A window has the hash of its plain words; a telling one also those of its templates: with each capitalised
    word as a name, with those inside a sentence only, and with the item's first word as a name, as a document
    may begin a sentence there. `need` telling windows, or `whole` windows of any kind, make a leak.
    """
    items = benchmark.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    (plain, template), (_, inside) = tokens(F.col("clean")), tokens(F.col("clean"), _INSIDE)
    items = items.withColumn("clean", cleaned(F.col("text"))).select(F.md5("text").alias("item"), "ids", plain.alias("plain"), template.alias("template"), inside.alias("inside")).filter(F.size("template") >= LEAST)
    items = items.withColumn("size", F.least(F.size("template"), F.lit(WINDOW)))
    begun = lambda c: F.concat(F.array(F.lit(NAME)), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))))
    views = ("plain", "template", "inside", "begun")
    items = items.withColumn("begun", begun(F.col("inside")))
    rows = items.withColumn("w", F.arrays_zip(*[_all_windows(F.col(v)).alias(v) for v in views]))
    rows = rows.drop("begun").select(*[c for c in items.columns if c != "begun"], F.posexplode("w").alias("ipos", "w"))
    slots = F.size(F.filter(F.slice("inside", F.col("ipos") + 1, F.col("size")), _is_slot))
    telling = slots <= F.col("size") * (1 - PLAIN)
    hashes = F.when(telling, F.array_distinct(F.array(*[F.col(f"w.{v}") for v in views]))).otherwise(F.array("w.plain"))
    rows = rows.withColumn("telling", telling).withColumn("hashes", hashes).drop("w")
    count = rows.groupBy("item").agg(F.least(F.count_if("telling"), F.lit(HITS)).alias("need"), F.least(F.count(F.lit(1)), F.lit(HITS)).alias("whole"))
    return materialize(rows.join(count, "item"), "windows")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(cls, items, n_windows): the texts that hold a passage of the benchmark, by their MD5; a materialized table."""
    windows = benchmark_windows(benchmark)
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # WINDOW - LEAST + 1 values at most
    probe = windows.select(F.explode("hashes").alias("hash"), "size", "item", "ipos")
    small = probe.limit(BROADCAST + 1).count() <= BROADCAST
    texts = docs.select(F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")))).alias("cls"), cleaned(docs["text"]).alias("text"))
    plain, template = tokens(F.col("text"))
    found = None
    for size in sizes or [WINDOW]:
        views = texts.select("cls", plain.alias("plain"), template.alias("template"))
        hashed = views.select("cls", window_hashes(F.col("plain"), size).alias("p"), window_hashes(F.col("template"), size).alias("t"))
        # one row for each window of plain words, and one more where its template says something else
        both = F.concat("p", F.zip_with("p", "t", lambda p, t: F.when(p != t, t)))
        rows = hashed.select("cls", F.size("p").alias("n"), F.posexplode(both).alias("k", "hash")).filter("hash is not null")
        rows = rows.select("cls", (F.col("k") % F.col("n")).alias("dpos"), "hash")
        own = probe.filter(F.col("size") == size).drop("size")
        hits = rows.join(F.broadcast(own) if small else own, "hash").select("cls", "item", "ipos", "dpos")
        found = hits if found is None else found.unionByName(hits)
    # the windows of a passage are fewer than its item's; copies of a text give the same rows
    passages = found.withColumn("diagonal", F.col("dpos") - F.col("ipos")).groupBy("cls", "item", "diagonal").agg(F.collect_set("ipos").alias("at"))
    items = windows.groupBy("item").agg(F.first("ids").alias("ids"), F.first("plain").alias("plain"), F.first("template").alias("template"), F.first("inside").alias("inside"), F.first("size").alias("size"), F.first("need").alias("need"), F.first("whole").alias("whole"), F.collect_set(F.when(F.col("telling"), F.col("ipos"))).alias("telling"))
    passages = materialize(small_join(passages, materialize(items, "items"), ["item"], "inner", BROADCAST).filter(F.size("at") >= F.when(F.col("need") > 0, F.col("need")).otherwise(F.col("whole"))), "passages")

    wanted = passages.select("cls").distinct()
    plain, template = tokens(F.col("text"))
    said = only_keys(texts, passages, ["cls"]).join(materialize(wanted, "wanted"), "cls").groupBy("cls").agg(F.first("text").alias("text"))
    said = said.select("cls", plain.alias("said"), template.alias("shape"))
    rows = passages.join(said, "cls")
    # exact: the tokens of each window, not only their hashes; each agrees as a word or as a slot of its kind
    def token(column: str, k: Column) -> Column:
        return F.element_at(column, (k + 1).cast("int"))

    def same(i: Column) -> Column:
        there = i + F.col("diagonal")
        word = F.slice("plain", i + 1, F.col("size")) == F.slice("said", there + 1, F.col("size"))
        agree = F.forall(F.sequence(i, i + F.col("size") - 1), lambda k: (token("plain", k) == token("said", k + F.col("diagonal"))) | (token("template", k) == token("shape", k + F.col("diagonal"))))
        return word | (F.array_contains("telling", i) & agree)

    rows = rows.withColumn("at", F.filter("at", same))
    covered = F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(i, i + F.col("size") - 1))))
    slots = F.filter(covered, lambda k: _is_slot(F.element_at("template", (k + 1).cast("int"))))
    pairs = F.array_distinct(F.transform(slots, lambda k: F.struct(F.element_at("plain", (k + 1).cast("int")).alias("item"), F.element_at("said", (k + F.col("diagonal") + 1).cast("int")).alias("doc"))))
    consistent = _all_differ(pairs, "item") & _all_differ(pairs, "doc")
    # a few words say too little to take what only begins a sentence ("What") for a name
    first = F.forall(slots, lambda k: (F.col("size") == WINDOW) | _is_slot(token("inside", k)) | (token("plain", k) == token("said", k + F.col("diagonal"))))
    enough = ((F.col("need") > 0) & (F.size(F.array_intersect("at", "telling")) >= F.col("need"))) | (F.size("at") >= F.col("whole"))
    good = rows.filter(enough & consistent & first)
    return materialize(good.groupBy("cls").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"), F.sum(F.size("at")).cast("long").alias("n_windows")), "leaks")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with contaminated, items (sorted ids of the benchmark) and n_windows (windows that match).

    A text is contaminated if HITS windows of one item (all of a shorter one) stand in it in line, with
    consistent slots. Windows of more slots than words (sums, dates, lists of names) count as exact copies only,
    and are not needed where others are found. A name is one word: a restatement with a name of more words
    ("Mary Jane" for "Alice") or a number of more ("twenty five" for "9") is not found, nor one in capitals only;
    verbatim copies of such items are. Characters that placeholders use are blanks. A very long text is one row of
    one task, its windows are rows of their own. Null texts are empty; equal texts, repeated rows and null ids are judged alike; items
    that are null or of fewer than LEAST tokens match nothing, items with one text share it, null item ids are
    left out of items; an empty benchmark or table is no error. docs needs text, benchmark item_id and text;
    other columns come back, but for those that have one of the three names above.
    """
    docs = docs.drop("contaminated", "items", "n_windows")
    rows = small_join(_keyed(docs), leaks(docs, benchmark), ["cls"], "left")
    return rows.select(*[F.col(f"doc.`{c}`") for c in docs.columns], F.col("n_windows").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, cls): all columns of docs, whatever their names, and the MD5 of the text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")))).alias("cls"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that find_leaks() finds clean, with their columns."""
    return small_join(_keyed(docs), leaks(docs, benchmark).select("cls"), ["cls"], "left_anti").select("doc.*")
