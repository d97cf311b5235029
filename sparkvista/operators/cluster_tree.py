"""Greedy hierarchical clusters of map points, equal to a sequential pass in the order of a key.

Level by level from the greatest zoom, every node that no earlier centre has taken becomes a centre and takes the
nodes within the radius that are left. Run in rounds: a node of the least key among its undecided neighbours is a
centre, and its neighbours are decided; in the end each goes to the first centre in reach. Cells are so small
that two nodes of one cell are always neighbours, so that a cell has one candidate, and a node meets those of
the 25 cells around it only, however dense a place is. Coordinates are whole numbers, so that sums don't depend on
their order.

Joins are asked to merge: Spark takes the 25 copies of a node for as little as the node, and would send them through
the driver as a broadcast, in every round.

Nodes and their parents form a tree. Leaves are numbered in the order of their paths, so that the leaves of a
cluster are a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import numbered, stored
from .mapview import EXTENT, MAX_ZOOM, RADIUS, located, mercator

#: Units of a whole map, and how many cells away a neighbour can be.
UNITS, REACH = 1 << 32, 2


def reach(zoom: int) -> int:
    """The radius of clusters in units; whole for all zooms."""
    return RADIUS * UNITS // (EXTENT << zoom)


def _cells(rows: DataFrame, side: int) -> DataFrame:
    return rows.withColumns({"cx": F.floor(F.col("x") / F.lit(float(side))), "cy": F.floor(F.col("y") / F.lit(float(side)))})


def _around(rows: DataFrame) -> DataFrame:
    """Each row once for each cell around its own, to be joined by a merge."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-REACH, REACH + 1) for j in range(-REACH, REACH + 1)])
    rows = rows.withColumn("step", F.explode(steps))
    return rows.select((F.col("cx") + F.col("step.i")).alias("cx"), (F.col("cy") + F.col("step.j")).alias("cy"), F.col("rank").alias("c_rank"), F.col("x").alias("c_x"), F.col("y").alias("c_y")).hint("merge")


def _near(radius: int) -> Column:
    dx, dy = F.col("x") - F.col("c_x"), F.col("y") - F.col("c_y")
    return dx * dx + dy * dy <= radius * radius


def _side(radius: int) -> int:
    return int(radius * 0.7071067811865475)


def any_pair(nodes: DataFrame, radius: int) -> bool:
    """Whether two nodes are within the radius. Only if all cells have one node are neighbours compared."""
    rows = _cells(nodes.select("rank", "x", "y"), _side(radius))
    if not rows.groupBy("cx", "cy").count().filter("count > 1").isEmpty():
        return True
    return not rows.join(_around(rows), ["cx", "cy"]).filter(_near(radius) & (F.col("rank") < F.col("c_rank"))).isEmpty()


def assign(nodes: DataFrame, radius: int) -> DataFrame:
    """(rank, centre): for every node the key of the centre that takes it, its own if it is one; a table."""
    every = _cells(nodes.select("rank", "x", "y"), _side(radius))
    left, centres = every, None
    while True:
        first = left.groupBy("cx", "cy").agg(F.min(F.struct("rank", "x", "y")).alias("c")).select("cx", "cy", "c.*")
        late = left.join(_around(first), ["cx", "cy"]).filter((F.col("rank") < F.col("c_rank")) & _near(radius)).select(F.col("c_rank").alias("rank")).distinct()
        fresh = stored(first.join(late.hint("merge"), "rank", "left_anti"), "centres")
        centres = fresh if centres is None else centres.unionByName(fresh)
        taken = left.join(_around(fresh), ["cx", "cy"]).filter(_near(radius)).select("rank").distinct()
        left = stored(left.join(taken.hint("merge"), "rank", "left_anti"), "undecided")
        if left.isEmpty():
            break
    found = every.join(_around(centres), ["cx", "cy"]).filter(_near(radius))
    return stored(found.groupBy("rank").agg(F.min("c_rank").alias("centre")), "assigned")


def _merged(nodes: DataFrame, zoom: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of a zoom from those of the next greater one, and (rank, formed, parent) of nodes that a cluster took."""
    rows = nodes.join(assign(nodes, reach(zoom)).hint("merge"), "rank")
    weight = F.col("n").cast("decimal(18,0)")
    groups = rows.groupBy("centre").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"), F.sum(F.col("x").cast("decimal(18,0)") * weight).alias("sx"), F.sum(F.col("y").cast("decimal(18,0)") * weight).alias("sy"))
    rows = stored(rows.join(groups.hint("merge"), "centre"), f"zoom-{zoom}")
    alone, many = rows.filter("members = 1"), rows.filter("members > 1")
    made = many.filter("rank = centre").select("rank", F.lit(zoom).alias("formed"), F.col("total").alias("n"), F.expr("sx div total").alias("x"), F.expr("sy div total").alias("y"))
    return alone.select("rank", "formed", "n", "x", "y").unionByName(made), many.select("rank", "formed", F.struct(F.col("centre").alias("rank"), F.lit(zoom).alias("formed")).alias("parent"))


def _paths(edges: DataFrame) -> DataFrame:
    """(node, path) of every node, the path from its root to itself, by pointer jumping: five rounds at most for 22 levels."""
    rows = edges.select("node", F.col("parent").alias("up"), F.array("node").alias("path"))
    while True:
        rows = stored(rows, "paths")
        if rows.filter("up is not null").isEmpty():
            return rows.select("node", "path")
        above = rows.select(F.col("node").alias("up"), F.col("up").alias("beyond"), F.col("path").alias("before"))
        rows = rows.join(above.hint("merge"), "up", "left").select("node", F.col("beyond").alias("up"), F.concat(F.coalesce("before", F.array().cast(rows.schema["path"].dataType)), "path").alias("path"))


def cluster_tree(df: DataFrame, key: str = "business_id", max_zoom: int = MAX_ZOOM) -> DataFrame:
    """A row for each point and cluster: rank, formed, parent_rank, parent_formed, point_count, longitude, latitude, first_leaf, last_leaf, expansion_zoom.

    A node is named by the key of its first centre and the zoom at which it formed (max_zoom + 1: a point), and is
    shown from there up to the zoom at which its parent forms (null: none, it stays to zoom 0). Its leaves are the
    points whose first_leaf lies in its range; a cluster splits at expansion_zoom. Rows without valid coordinates
    are left out, as are null keys; keys must be distinct. An empty table gives an empty tree. Points in one place
    are one cluster at every zoom. In the worst order (keys that rise along a chain) rounds grow with the chain.
    """
    x, y = mercator()
    inside = located(df).filter(F.col(key).isNotNull())
    nodes = stored(inside.select(F.col(key).alias("rank"), F.lit(max_zoom + 1).alias("formed"), F.lit(1).cast("long").alias("n"), F.floor(x * UNITS).alias("x"), F.floor(y * UNITS).alias("y")), "points")
    every, edges = nodes, None
    low, high = -1, max_zoom  # no two nodes are within reach at zooms above the one sought
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if any_pair(nodes, reach(middle)) else (low, middle - 1)
    for zoom in range(low, -1, -1):
        nodes, taken = _merged(nodes, zoom)
        every = every.unionByName(nodes.filter(F.col("formed") == zoom))
        edges = taken if edges is None else edges.unionByName(taken)
    every = every.withColumn("node", F.struct("rank", "formed"))
    if edges is None:
        rows = every.withColumn("parent", F.lit(None).cast(every.schema["node"].dataType))
    else:
        rows = every.join(edges.hint("merge"), ["rank", "formed"], "left")
    rows = stored(rows, "nodes")
    paths = _paths(rows.select("node", "parent"))
    leaves = stored(numbered(paths.filter(F.col("node.formed") == max_zoom + 1), ["path"], "leaf"), "leaves")
    ranges = leaves.select("leaf", F.explode("path").alias("node")).groupBy("node").agg(F.min("leaf").alias("first_leaf"), F.max("leaf").alias("last_leaf"))
    rows = rows.join(ranges.hint("merge"), "node")
    lon = F.round(F.col("x") / UNITS * 360 - 180, 9)
    lat = F.round(F.degrees(2 * F.atan(F.exp((0.5 - F.col("y") / UNITS) * 2 * F.pi()))) - 90, 9)
    expansion = F.when(F.col("formed") <= max_zoom, F.least(F.col("formed") + 1, F.lit(max_zoom)))
    return rows.select("rank", "formed", F.col("parent.rank").alias("parent_rank"), F.col("parent.formed").alias("parent_formed"), F.col("n").alias("point_count"), lon.alias("longitude"), lat.alias("latitude"), "first_leaf", "last_leaf", expansion.alias("expansion_zoom"))


def clusters_at(tree: DataFrame, zoom: float, bbox: tuple[float, float, float, float] = (-180.0, -85.0, 180.0, 85.0)) -> DataFrame:
    """The nodes that a map shows at a zoom, within (west, south, east, north); a filter of the tree."""
    z = min(MAX_ZOOM, max(0, int(zoom // 1)))
    west, south, east, north = bbox
    shown = (F.col("formed") >= z) & F.coalesce(F.col("parent_formed") < z, F.lit(True))
    return tree.filter(shown & F.col("longitude").between(west, east) & F.col("latitude").between(south, north))


def children(tree: DataFrame, rank: object, formed: int) -> DataFrame:
    return tree.filter((F.col("parent_rank") == rank) & (F.col("parent_formed") == formed))


def leaves(tree: DataFrame, first_leaf: int, last_leaf: int) -> DataFrame:
    """The points of a cluster, by its range."""
    return tree.filter((F.col("expansion_zoom").isNull()) & F.col("first_leaf").between(first_leaf, last_leaf))
