"""A store of places for viewports: rows in the order of a Morton code, so that a box reads few row groups.

The code interleaves the bits of longitude and latitude on a grid of 65,536 by 65,536 cells. A box is a few ranges
of codes; the scan skips files and row groups whose least and greatest codes meet none of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .discovery import in_viewport

BITS = 16
CELLS = 1 << BITS
#: Most ranges of a box; a coarser cover reads a little more.
RANGES = 64


def _spread(n: Column) -> Column:
    """The 16 bits of n, a zero bit between each two."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return n


def cell_of(degrees: Column, span: float) -> Column:
    """The grid line of a coordinate within (-span, span); null and NaN have none."""
    at = F.floor((degrees + span) / (2 * span) * CELLS)
    return F.when(~F.isnan(degrees), F.least(F.greatest(at, F.lit(0)), F.lit(CELLS - 1)).cast("long"))


def morton() -> Column:
    return F.shiftleft(_spread(cell_of(F.col("latitude"), 90.0)), 1).bitwiseOR(_spread(cell_of(F.col("longitude"), 180.0)))


def ranges_of(south: float, west: float, north: float, east: float, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of codes that cover a box: its quarters, as far as there is room for more, neighbours joined."""
    line = lambda deg, span: max(0, min(CELLS - 1, math.floor((deg + span) / (2 * span) * CELLS)))
    low, high = (line(west, 180.0), line(south, 90.0)), (line(east, 180.0), line(north, 90.0))
    whole, split = [], [(0, 0, 0, CELLS)]  # (code of the first cell, x, y, side)
    while split and len(whole) + 4 * len(split) <= most:
        parts, split = split, []
        for code, x, y, side in parts:
            half = side // 2
            for k in range(4):
                a, b = x + (k & 1) * half, y + (k >> 1) * half
                if a > high[0] or b > high[1] or a + half <= low[0] or b + half <= low[1]:
                    continue
                quarter = (code + k * half * half, a, b, half)
                inside = a >= low[0] and b >= low[1] and a + half - 1 <= high[0] and b + half - 1 <= high[1]
                (whole if inside or half == 1 else split).append(quarter)
    joined: list[tuple[int, int]] = []
    for code, _, _, side in sorted(whole + split):
        if joined and joined[-1][1] + 1 == code:
            joined[-1] = (joined[-1][0], code + side * side - 1)
        else:
            joined.append((code, code + side * side - 1))
    return joined


@dataclass
class ViewportStore:
    rows: DataFrame

    @classmethod
    def write(cls, df: DataFrame, path: str, files: int = 8, row_group: int = 1 << 20) -> ViewportStore:
        """Writes df (longitude, latitude, other columns) in ranges of codes; rows without coordinates are kept, and in no box."""
        rows = df.withColumn("_code", morton())
        rows = rows.repartitionByRange(files, F.asc_nulls_first("_code")).sortWithinPartitions(F.asc_nulls_first("_code"))
        rows.write.mode("overwrite").option("parquet.block.size", row_group).parquet(path)
        return cls.read(df.sparkSession, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> ViewportStore:
        return cls(spark.read.parquet(path))

    def within(self, south: float, west: float, north: float, east: float) -> DataFrame:
        """The rows in a box, its edges included; inverted bounds give none."""
        near = F.lit(False)
        for low, high in ranges_of(south, west, north, east):
            near = near | F.col("_code").between(low, high)
        inside = F.col("latitude").between(south, north) & F.col("longitude").between(west, east)
        return self.rows.filter(near & inside).drop("_code")

    def in_viewport(self, south: float, west: float, north: float, east: float, limit: int = 1_000) -> DataFrame:
        """What discovery.in_viewport() gives over all rows."""
        return in_viewport(self.within(south, west, north, east), south, west, north, east, limit)
