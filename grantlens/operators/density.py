"""Density outliers and clusters by counting cells instead of pairing points.

Equal points are one location with a weight.  Locations lie in cells of side
eps / sqrt(d), so all points of a cell are within eps of each other.  Then

* a cell of ``min_pts`` points is core as a whole, without any pair;
* a location's neighbours are counted box by box: the points of a nearby cell
  are all in reach (their bounding box is), all out of reach, or undecided,
  and undecided boxes are cut in halves along every dimension and asked again;
  only boxes of ``LEAF`` locations or fewer are compared point by point;
* clusters are components of cells, not of points: two core cells hang
  together if two of their core points do, which is decided by boxes and one
  point of each, and by smaller boxes where that does not settle it.

Every distance test rounds as the test between two points does (all steps are
monotone), so the results are those of comparing all points.

Cells find their neighbours by an equi-join on a coarse grid of at most three
dimensions, those of the widest spread.  Rounds of boxes are written to the
shared folder; there is one round per halving that is still undecided.

Points with a null or NaN coordinate are left out.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.operators.components import connected_components
from grantlens.operators.ranking import ranked
from grantlens.plans.materialize import written

#: Locations of a box that are compared point by point; halvings after which every box is.
LEAF, DEEPEST = 32, 48
#: Dimensions of the coarse grid, and its width in eps (two cells in reach differ by less).
GRID_DIMENSIONS, GRID_WIDTH = 3, 2.1


def _sum(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _square(v: Column) -> Column:
    return v * v


class Grid:
    """Distances in d dimensions over array columns."""

    def __init__(self, d: int, eps: float):
        self.d, self.eps, self.limit = d, eps, F.lit(eps * eps)
        self.side = eps / math.sqrt(d)

    def between(self, a: str, b: str) -> Column:
        return _sum(_square(F.get(a, F.lit(i)) - F.get(b, F.lit(i))) for i in range(self.d))

    def least(self, lo1: str, hi1: str, lo2: str, hi2: str) -> Column:
        """Squared distance of two boxes; a point is a box of its own."""
        gap = (F.greatest(F.get(lo2, F.lit(i)) - F.get(hi1, F.lit(i)), F.get(lo1, F.lit(i)) - F.get(hi2, F.lit(i)), F.lit(0.0)) for i in range(self.d))
        return _sum(map(_square, gap))

    def most(self, lo1: str, hi1: str, lo2: str, hi2: str) -> Column:
        """Squared distance of the farthest points that two boxes may hold."""
        far = (F.greatest(F.get(hi2, F.lit(i)) - F.get(lo1, F.lit(i)), F.get(hi1, F.lit(i)) - F.get(lo2, F.lit(i))) for i in range(self.d))
        return _sum(map(_square, far))

    def cell(self, level: int) -> Column:
        """The cell of a location after ``level`` halvings; cells are nested, as powers of two scale exactly."""
        return F.transform("x", lambda v: F.floor(v / F.lit(self.side) * F.lit(float(2 ** level))))

    def boxes(self, locations: DataFrame, level: int) -> DataFrame:
        """(cid, cell, n, weight, lo, hi, any): bounding box, locations, points and one location of every cell."""
        at = [F.get("x", F.lit(i)) for i in range(self.d)]
        return locations.groupBy("cid", self.cell(level).alias("cell")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), F.array(*map(F.min, at)).alias("lo"),
            F.array(*map(F.max, at)).alias("hi"), F.min_by("x", "loc").alias("any"))


def locations_of(points: DataFrame, key: str, cols, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """(key, x) of the points, and (loc, x, weight, least, cid): their different places and cells."""
    rows = points.select(F.col(key).alias("key"), F.array(*(F.col(c).cast("double") + F.lit(0.0) for c in cols)).alias("x"))
    rows = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    places = rows.groupBy("x").agg(F.count(F.lit(1)).alias("weight"), F.min("key").alias("least"))
    # Numbers follow the written files, so a repeated task gives the same ones.
    places = written(places.withColumn("cell", grid.cell(0)), "locations").withColumn("loc", F.monotonically_increasing_id())
    cells = places.groupBy("cell").agg(F.min("loc").alias("cid"))
    return rows, written(places.join(cells, "cell").select("loc", "x", "weight", "least", "cid"), "locations")


def near_cells(locations: DataFrame, grid: Grid) -> DataFrame:
    """(cid, other): pairs of cells, each with itself, whose boxes are in reach of each other; both directions."""
    boxes = grid.boxes(locations, 0).select("cid", "lo", "hi")
    spread = boxes.agg(*(F.max(F.get("hi", F.lit(i))) - F.min(F.get("lo", F.lit(i))) for i in range(grid.d))).first()
    widest = sorted(range(grid.d), key=lambda i: (-(spread[i] or 0.0), i))[:GRID_DIMENSIONS]
    width = F.lit(GRID_WIDTH * grid.eps)
    home = boxes.select("*", F.array(*(F.floor(F.get("lo", F.lit(i)) / width) for i in widest)).alias("g"))
    steps = [()]
    for _ in widest:
        steps = [(*s, k) for s in steps for k in (-1, 0, 1)]
    around = F.array(*(F.array(*(F.get("g", F.lit(i)) + k for i, k in enumerate(s))) for s in steps))
    probe = home.select("cid", "lo", "hi", F.explode(around).alias("g"))
    other = home.select(F.col("cid").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), "g")
    return probe.join(other, "g").where(grid.least("lo", "hi", "lo2", "hi2") <= grid.limit).select("cid", "other")


def neighbor_counts(some: DataFrame, locations: DataFrame, near: DataFrame, grid: Grid) -> DataFrame:
    """(loc, n_neighbors) of the locations ``some``: the points within eps, those of the location included."""
    todo = some.join(near, "cid").select("loc", "x", F.col("other").alias("cid"))
    level, counts = 0, []
    while True:
        boxes = grid.boxes(locations, level).select("cid", "cell", "n", "weight", "lo", "hi")
        met = todo.join(boxes, ["cid"] if level == 0 else ["cid", "cell"])
        inside = grid.most("x", "x", "lo", "hi") <= grid.limit
        found = written(met.where(grid.least("x", "x", "lo", "hi") <= grid.limit).groupBy("loc", "x").agg(
            F.sum(F.when(inside, F.col("weight"))).alias("count"),
            F.collect_list(F.when(~inside, F.struct("cid", "cell", "n"))).alias("open")), "neighbor-boxes")
        counts.append(found.where("count is not null").select("loc", "count"))
        left = found.where(F.size("open") > 0).select("loc", "x", F.explode("open").alias("_o")).select("loc", "x", "_o.*")
        leaf = F.lit(True) if level == DEEPEST else F.col("n") <= LEAF
        others = locations.select("cid", grid.cell(level).alias("cell"), F.col("x").alias("y"), "weight")
        counts.append(left.where(leaf).join(others, ["cid", "cell"]).where(grid.between("x", "y") <= grid.limit)
                      .groupBy("loc").agg(F.sum("weight").alias("count")))
        large = left.where(~leaf)
        if level == DEEPEST or not large.limit(1).count():
            break
        halves = locations.select("cid", grid.cell(level).alias("cell"), grid.cell(level + 1).alias("half")).distinct()
        todo = large.join(halves, ["cid", "cell"]).select("loc", "x", "cid", F.col("half").alias("cell"))
        level += 1
    return reduce(DataFrame.unionByName, counts).groupBy("loc").agg(F.sum("count").alias("n_neighbors"))


def core_locations(locations: DataFrame, near: DataFrame, grid: Grid, min_pts: int) -> DataFrame:
    """The core ones of the locations.  Only cells with too few points of their own are looked at more closely."""
    cells = grid.boxes(locations, 0)
    whole = (F.col("weight") >= min_pts) & (grid.most("lo", "hi", "lo", "hi") <= grid.limit)
    judged = cells.select("cid", whole.alias("dense"))
    of = locations.join(judged, "cid")
    counts = neighbor_counts(of.where("not dense").select("loc", "x", "cid"), locations, near, grid)
    sparse = of.where("not dense").join(counts.where(F.col("n_neighbors") >= min_pts), "loc")
    return of.where("dense").select(*locations.columns).unionByName(sparse.select(*locations.columns))


def linked_cells(core: DataFrame, near: DataFrame, grid: Grid) -> DataFrame:
    """(a, b), a < b: cells of which two core locations are within eps."""
    some = core.select("cid").distinct()
    pairs = near.where("cid < other").join(some, "cid").join(some.withColumnRenamed("cid", "other"), "other")
    todo, level, links = pairs.select(F.col("cid").alias("a"), F.col("other").alias("b")), 0, []
    while True:
        boxes = grid.boxes(core, level)
        one, two = (boxes.select(F.col("cid").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("cell", "n", "lo", "hi", "any"))) for x in "ab")
        met = todo.join(one, ["a"] if level == 0 else ["a", "cella"]).join(two, ["b"] if level == 0 else ["b", "cellb"])
        linked = (grid.most("loa", "hia", "lob", "hib") <= grid.limit) | (grid.between("anya", "anyb") <= grid.limit)
        found = written(met.where(grid.least("loa", "hia", "lob", "hib") <= grid.limit).groupBy("a", "b").agg(
            F.max(linked).alias("linked"),
            F.collect_list(F.when(~linked, F.struct("cella", "cellb", (F.col("na") * F.col("nb")).alias("n")))).alias("open")), "cell-links")
        links.append(found.where("linked").select("a", "b"))
        left = found.where("not linked").select("a", "b", F.explode("open").alias("_o")).select("a", "b", "_o.*")
        leaf = F.lit(True) if level == DEEPEST else F.col("n") <= LEAF * LEAF
        x, y = (core.select(F.col("cid").alias(c), grid.cell(level).alias(f"cell{c}"), F.col("x").alias(f"x{c}")) for c in "ab")
        links.append(left.where(leaf).join(x, ["a", "cella"]).join(y, ["b", "cellb"]).where(grid.between("xa", "xb") <= grid.limit).select("a", "b"))
        large = left.where(~leaf)
        if level == DEEPEST or not large.limit(1).count():
            break
        x, y = (core.select(F.col("cid").alias(c), grid.cell(level).alias(f"cell{c}"), grid.cell(level + 1).alias(f"half{c}")).distinct() for c in "ab")
        todo = large.join(x, ["a", "cella"]).join(y, ["b", "cellb"]).select("a", "b", F.col("halfa").alias("cella"), F.col("halfb").alias("cellb"))
        level += 1
    return reduce(DataFrame.unionByName, links).distinct()


def core_in_reach(locations: DataFrame, core: DataFrame, near: DataFrame, grid: Grid, value: str) -> DataFrame:
    """(loc, value): the least ``value`` of the core locations within eps of each of the locations.

    Asked for locations that are not core, which lie in cells of fewer than min_pts points, so that a core
    location meets a bounded number of them.
    """
    boxes = grid.boxes(core, 0).select(F.col("cid").alias("other"), "lo", "hi")
    asked = locations.join(near, "cid").join(boxes, "other").where(grid.least("x", "x", "lo", "hi") <= grid.limit)
    there = core.select(F.col("cid").alias("other"), F.col("x").alias("y"), value)
    return (asked.select("loc", "x", "other").join(there, "other").where(grid.between("x", "y") <= grid.limit)
            .groupBy("loc").agg(F.min(value).alias(value)))


def density_outliers(points: DataFrame, key: str, cols, eps: float = 1.0, min_pts: int = 5) -> DataFrame:
    """C4: (key, n_neighbors (self included), is_core, is_noise); noise has no core point within eps."""
    grid = Grid(len(cols), eps)
    rows, locations = locations_of(points, key, cols, grid)
    near = written(near_cells(locations, grid), "near-cells")
    counted = written(locations.join(neighbor_counts(locations, locations, near, grid), "loc"), "neighbor-counts")
    core = counted.where(F.col("n_neighbors") >= min_pts)
    reach = core_in_reach(counted.where(F.col("n_neighbors") < min_pts), core.withColumn("reached", F.lit(1)), near, grid, "reached")
    is_core = F.col("n_neighbors") >= min_pts
    judged = counted.join(reach, "loc", "left").select(
        "x", "n_neighbors", is_core.alias("is_core"), (~is_core & F.col("reached").isNull()).alias("is_noise"))
    return rows.join(judged, "x").select(F.col("key").alias(key), "n_neighbors", "is_core", "is_noise")


def density_clusters(points: DataFrame, key: str, cols, eps: float = 1.0, min_pts: int = 5) -> DataFrame:
    """(key, cluster): clusters numbered by their least core key, -1 for noise.

    A point that is not core takes the cluster of the least label among the core points within eps.
    """
    grid = Grid(len(cols), eps)
    rows, locations = locations_of(points, key, cols, grid)
    near = written(near_cells(locations, grid), "near-cells")
    core = written(core_locations(locations, near, grid, min_pts), "core-locations")
    parts = connected_components(linked_cells(core, near, grid), "a", "b")
    of_cell = core.groupBy("cid").agg(F.min("least").alias("least")).join(parts, F.col("cid") == F.col("node"), "left").select(
        "cid", "least", F.coalesce("component", "cid").alias("component"))
    label = of_cell.groupBy("component").agg(F.min("least").alias("label"))
    number = ranked(label, ["label"], "cluster")
    labelled = written(of_cell.join(number, "component").select("cid", "cluster"), "cell-clusters")
    inside = core.join(labelled, "cid").select("loc", "x", "weight", "cid", "cluster")
    rest = locations.join(core.select("loc"), "loc", "left_anti")
    border = core_in_reach(rest, inside, near, grid, "cluster")
    judged = inside.select("x", "cluster").unionByName(rest.join(border, "loc", "left").select("x", "cluster"))
    return rows.join(judged, "x").select(F.col("key").alias(key), F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))
