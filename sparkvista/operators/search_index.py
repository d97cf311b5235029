"""An inverted index of trigrams behind the ranked search.

The index is a table of postings (gram, field, key) in the order of grams, whose files and row groups a scan skips
by their minima, and the rows with their trigrams. A search asks it which rows can match: by counts of the
trigrams that a field shares with a term, or by holding all trigrams that a pattern's letters ask for. Only these
rows are read, verified and ranked, by the same search as without an index.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.trigram import trigrams, trigrams_of
from .discovery import FIELDS, SIMILAR, TEXTS, search, with_trigrams

KEY = "business_id"

#: Postings that one task makes, and that one file has, on average.
POSTINGS = 1 << 18


def needed_trigrams(term: str) -> list[str]:
    """Trigrams that a text with %term% surely has: those of letters and digits in a row, apart from wildcards."""
    literal = re.sub(r"\\([%_\\])", " ", term.lower()).replace("\\", "")
    runs = re.split(r"[\W_%]+", literal)
    return sorted({r[k : k + 3] for r in runs for k in range(len(r) - 2)})


def _posted(field: str, grams: Column) -> Column:
    return F.transform(grams, lambda g: F.struct(g.alias("gram"), F.lit(field).alias("field"), F.size(grams).alias("size")))


@dataclass
class SearchIndex:
    rows: DataFrame
    postings: DataFrame

    @classmethod
    def write(cls, df: DataFrame, path: str, files: int = 16) -> SearchIndex:
        """Writes the index of df (business_id and the searched fields) to a folder.

        A null field has no trigrams; a key that repeats is all its rows. Postings of a common trigram are many rows
        of several files, never one value. Texts are dealt before they become postings, to as many tasks as there
        are POSTINGS, files at least, and equal postings meet within a file's task, so that a task's memory doesn't
        grow with the table.
        """
        with_trigrams(df).write.mode("overwrite").parquet(f"{path}/rows")
        rows = df.sparkSession.read.parquet(f"{path}/rows")
        sizes = [F.size(f"{c}_trigrams" if c in FIELDS else trigrams(F.col(c))) for c in TEXTS]
        files = max(files, (rows.select(F.sum(sum(sizes, F.lit(0)).cast("long"))).first()[0] or 0) // POSTINGS)
        grams = F.inline(F.array(F.struct(*[trigrams(F.col(c)).alias(c) for c in TEXTS])))  # worked out once, as in with_trigrams
        dealt = rows.select(KEY, *TEXTS).repartition(files, KEY, *TEXTS).select(KEY, grams)
        postings = dealt.select(KEY, F.explode(F.concat(*[_posted(c, F.col(c)) for c in TEXTS])).alias("p")).select("p.*", KEY)
        postings = postings.repartitionByRange(files, "gram", KEY).distinct()
        postings.sortWithinPartitions("gram", "field", KEY).write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
        return cls.read(df.sparkSession, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> SearchIndex:
        return cls(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/postings"))

    def candidates(self, query: str) -> DataFrame | None:
        """The keys of rows that can match; None: any row can, as for a blank query or a pattern of fewer than three letters."""
        terms = query.strip().lower().split()
        if not terms or any(not needed_trigrams(t) for t in terms):
            return None
        found = None
        for t in terms:
            near, inside = trigrams_of(t), needed_trigrams(t)
            hits = self.postings.filter(F.col("gram").isin(sorted({*near, *inside})))
            shared = F.count(F.when(F.col("gram").isin(near), 1))
            whole = F.count(F.when(F.col("gram").isin(inside), 1))
            hits = hits.groupBy(KEY, "field").agg(shared.alias("shared"), whole.alias("whole"), F.max("size").alias("size"))
            similar = (F.col("shared") / (F.col("size") + len(near) - F.col("shared"))).cast("float").cast("double") > SIMILAR
            keys = hits.filter((F.col("field").isin(*FIELDS) & similar) | (F.col("whole") == len(inside))).select(KEY)
            found = keys if found is None else found.union(keys)
        return found.distinct()

    def search(self, query: str, skip: int = 0, limit: int = 20) -> DataFrame:
        """What search() gives over all rows."""
        keys = self.candidates(query)
        rows = self.rows if keys is None else self.rows.join(keys, KEY, "left_semi")
        return search(rows, query, skip, limit)
