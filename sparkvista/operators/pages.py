"""Deep pages: the rows at any offset of an order, without a task that keeps the rows before them.

The place of a page is found by histograms of the sort keys: a count by bin tells in which bin an offset lies, and
that bin is split again, by its own range and then by the next key where all its rows are equal, until it is
small. Only the rows from the first bin of the page to its last one are sorted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bins of a histogram, and rows that a bin may have and still be sorted.
BINS, ENOUGH = 1_024, 20_000
Order = list[tuple[str, bool]]


def _key(column: str, descending: bool) -> Column:
    """A number that rises in the order: nulls first, as -infinity; of falling keys NaN next."""
    value = F.col(column).cast("double")
    return F.coalesce(F.when(F.isnan(value), F.lit(-1.7e308 if descending else 1.7e308)).otherwise(-value if descending else value), F.lit(float("-inf")))


def _sorts(order: Order) -> list[Column]:
    return [F.desc_nulls_first(c) if down else F.asc_nulls_first(c) for c, down in order]


@dataclass
class Bin:
    """Rows whose keys have the values `fixed`, and whose next key lies in [low, high]; `before` come before them."""

    before: int = 0
    fixed: list[tuple[Column, float]] = field(default_factory=list)
    last: tuple[Column, float, float] | None = None

    def rows(self) -> Column:
        found = F.lit(True)
        for k, v in self.fixed:
            found = found & (k == v)
        return found if self.last is None else found & self.last[0].between(self.last[1], self.last[2])

    def bound(self, after: bool) -> Column:
        """Rows from the bin's first on, or up to its last, in the order of the keys."""
        found = F.lit(True)
        if self.last is not None:
            found = self.last[0] >= self.last[1] if after else self.last[0] <= self.last[2]
        for k, v in reversed(self.fixed):
            found = ((k > v) if after else (k < v)) | ((k == v) & found)
        return found


def _bin_of(df: DataFrame, keys: list[Column], place: int, bins: int, enough: int) -> Bin:
    at, keys = Bin(), list(keys)
    ends = None
    while keys:
        k = keys[0]
        part = df.filter(at.rows()).select(k.alias("k"))
        if ends is None:
            ends = part.filter(F.col("k") > float("-inf")).agg(F.min("k"), F.max("k")).first()
        low, high = (0.0, 0.0) if ends[0] is None else ends
        step = (high / bins - low / bins) or 1.0
        nth = F.when(F.col("k") == float("-inf"), -1).otherwise(F.least(F.floor(F.col("k") / step - low / step), F.lit(bins - 1)))
        found = sorted(tuple(r) for r in part.groupBy(nth.alias("nth")).agg(F.count(F.lit(1)), F.min("k"), F.max("k")).collect())  # bins + 1 rows at most
        for _, count, first, last in found:
            if at.before + count > place:
                break
            at.before += count
        else:
            return Bin(at.before, at.fixed, (k, float("inf"), float("inf")))  # past the end
        if first == last:
            at.fixed.append((k, first))
            at.last, ends = None, None
            keys.pop(0)
        else:
            at.last, ends = (k, first, last), (first, last)
        if count <= enough or len(found) == 1 and first != last and (first, last) == (low, high):
            break
    return at


def deep_page(df: DataFrame, order: Order, skip: int, limit: int, bins: int = BINS, enough: int = ENOUGH) -> DataFrame:
    """df.orderBy(order).offset(skip).limit(limit), for any skip; order has (column, descending), nulls first.

    Leading numeric keys are binned, as doubles; the first key of another type ends the search, so that rows equal in
    all keys before it are sorted together. Rows equal in all keys are in any order. A page past the end is empty.
    """
    keys = []
    for c, down in order:
        if not isinstance(df.schema[c].dataType, T.NumericType):
            break
        keys.append(_key(c, down))
    first = _bin_of(df, keys, skip, bins, enough)
    last = _bin_of(df, keys, skip + limit - 1, bins, enough) if limit > 1 else first
    rows = df.filter(first.bound(True) & last.bound(False))
    return rows.orderBy(*_sorts(order)).offset(skip - first.before).limit(limit)
