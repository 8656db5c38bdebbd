"""World objects: bounds, partitions, tiles, overlaps and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.intmath import floor_div
from loamgrid.operators.geometry import bounds, in_parts

#: Side of a partition cell in millimetres.
PARTITION = 128_000


def screen_bounds(boxes: DataFrame) -> DataFrame:
    """Extrema of x - y and x + y - 2 z over a box's corners, anchor and radius."""
    top = F.col("min_z") + F.col("height")
    side = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    return boxes.select("id", (F.col("min_x") - F.col("max_y")).alias("min_x"), (F.col("max_x") - F.col("min_y")).alias("max_x"), (F.col("min_x") + F.col("min_y") - 2 * top).alias("min_y2"), (F.col("max_x") + F.col("max_y") - 2 * F.col("min_z")).alias("max_y2"), (F.col("min_x") + floor_div(F.col("max_x") - F.col("min_x"), 2)).alias("anchor_x"), (F.col("min_y") + floor_div(F.col("max_y") - F.col("min_y"), 2)).alias("anchor_y"), floor_div(side, 2).alias("radius"))


def layout_extent(bounds: DataFrame, margin: int) -> DataFrame:
    """The extent of all screen bounds with a margin on every side; nulls without rows."""
    least, most = ["min_x", "min_y2"], ["max_x", "max_y2"]
    low = [(F.min(c) - margin).alias(c) for c in least]
    high = [(F.max(c) + margin).alias(c) for c in most]
    return bounds.agg(*low, *high)


def first_named(objects: DataFrame) -> DataFrame:
    """The object with the least id of every name; objects without a name are left out."""
    return objects.where("name is not null").groupBy("name").agg(F.min("id").alias("id"))


def spread(boxes: DataFrame, side: int, px: str, py: str) -> DataFrame:
    """A row for each cell of the given side that a box touches."""
    span = lambda lo, hi: F.explode(F.sequence(floor_div(lo, side), floor_div(hi, side)))
    return boxes.select("*", span("min_x", "max_x").alias(px)).select("*", span("min_y", "max_y").alias(py))


def partitions(boxes: DataFrame) -> DataFrame:
    return spread(boxes, PARTITION, "px", "py").select("px", "py", "id")


def overlapping(tiles: DataFrame, boxes: DataFrame, side: int) -> DataFrame:
    """Tiles and the boxes that touch them, edges included: an equi-join on cells, then the exact test."""
    cut = spread(boxes.drop("class", "min_z", "height"), side, "cx", "cy")
    # A touch on a tile's far edge lies in the next cell: each tile looks into its own cell and those after it.
    keyed = tiles.withColumn("cx", F.explode(F.array("tx", F.col("tx") + 1))).withColumn("cy", F.explode(F.array("ty", F.col("ty") + 1)))
    x0, y0 = F.col("tx") * side, F.col("ty") * side
    hit = (F.col("max_x") >= x0) & (F.col("min_x") <= x0 + side) & (F.col("max_y") >= y0) & (F.col("min_y") <= y0 + side)
    # A box is met once: in the first of the tile's cells that it touches.
    once = (F.col("cx") == F.greatest(F.col("tx"), floor_div("min_x", side))) & (F.col("cy") == F.greatest(F.col("ty"), floor_div("min_y", side)))
    return keyed.join(cut, ["cx", "cy"]).where(hit & once).select("tx", "ty", "id")


def uncovered(cells: DataFrame, boxes: DataFrame, side: int) -> DataFrame:
    """Cells whose centre lies in no box: binned by cell, then the exact test."""
    cut = spread(boxes.select("min_x", "max_x", "min_y", "max_y"), side, "col", "row")
    x, y = F.col("col") * side + side // 2, F.col("row") * side + side // 2
    inside = cut.where((F.col("min_x") <= x) & (x < F.col("max_x")) & (F.col("min_y") <= y) & (y < F.col("max_y"))).select("col", "row")
    return cells.join(inside, ["col", "row"], "left_anti")


def largest_of_class(boxes: DataFrame) -> DataFrame:
    """The object with the greatest radius of each class, ties to the greater id."""
    side = floor_div(F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")), 2)
    return boxes.groupBy("class").agg(F.max(F.struct(side.alias("radius"), "id")).alias("m")).select("class", "m.id", "m.radius")


def uncovered_by_parts(cells: DataFrame, shapes: DataFrame, side: int) -> DataFrame:
    """Cells (col, row) whose centre lies in no shape (id, parts): shapes are binned by the cells their box touches."""
    boxed = shapes.withColumn("_b", bounds(F.col("parts"), F.lit(0))).select("id", "parts", "_b.min_x", "_b.max_x", "_b.min_y", "_b.max_y")
    # Keys meet before the shapes: a cell is compared with the shapes of its own bin only.
    near = spread(boxed, side, "col", "row")
    x, y = F.col("col") * side + side // 2, F.col("row") * side + side // 2
    in_box = x.between(F.col("min_x"), F.col("max_x")) & y.between(F.col("min_y"), F.col("max_y"))
    return cells.join(near.where(in_box & in_parts(F.col("parts"), x, y)).select("col", "row"), ["col", "row"], "left_anti")


#: Corner, side and columns of the evidence grid.
GRID_X, GRID_Y, GRID_SIDE, GRID_COLUMNS = 43_583, 86_784, 20_000, 31


def cell_of(x: Column, y: Column) -> Column:
    """The number of the grid cell of a local point, row by row; null outside the grid."""
    col, row = floor_div(x - GRID_X, GRID_SIDE), floor_div(y - GRID_Y, GRID_SIDE)
    return F.when(col.between(0, GRID_COLUMNS - 1) & row.between(0, GRID_COLUMNS - 1), row * GRID_COLUMNS + col)


def mismatched_cells(wanted: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("col", "row")) -> DataFrame:
    """The keys and problem of cells without evidence ('missing') and of evidence without a cell ('unexpected')."""
    both = wanted.select(*keys, F.lit(True).alias("_w")).join(found.select(*keys, F.lit(True).alias("_f")), list(keys), "full_outer")
    return both.where("_w is null or _f is null").select(*keys, F.when(F.col("_w").isNull(), "unexpected").otherwise("missing").alias("problem"))


def inspection(objects: DataFrame) -> DataFrame:
    """One row: objects, those with a name, classes and sources."""
    sources = objects.select(F.explode("source_ids").alias("s")).agg(F.countDistinct("s").alias("sources"))
    return objects.agg(F.count("*").alias("objects"), F.count("name").alias("named"), F.countDistinct("class").alias("classes")).crossJoin(F.broadcast(sources))  # a row each
