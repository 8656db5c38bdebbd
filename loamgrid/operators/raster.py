"""Kernels on long rasters (raster_id, y, x, value): windows along rows, columns and diagonals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row():
    return Window.partitionBy("raster_id", "y").orderBy("x")


def column():
    return Window.partitionBy("raster_id", "x").orderBy("y")


def scharr(raster: DataFrame) -> DataFrame:
    """L1 magnitude of the 3-10-3 gradient; 0 where the 3 x 3 neighbourhood is not whole."""
    near = lambda c, w, d: F.lag(c, 1).over(w) if d < 0 else F.lead(c, 1).over(w)
    rows = raster.withColumns({"a": near("v", row(), 1) - near("v", row(), -1), "b": 3 * near("v", row(), -1) + 10 * F.col("v") + 3 * near("v", row(), 1)})
    both = rows.withColumns({"dx": 3 * near("a", column(), -1) + 10 * F.col("a") + 3 * near("a", column(), 1), "dy": near("b", column(), 1) - near("b", column(), -1)})
    return both.select("raster_id", "y", "x", F.coalesce(F.abs("dx") + F.abs("dy"), F.lit(0)).cast("bigint").alias("magnitude"))


def counted(raster: DataFrame, radius: int) -> Column:
    """On pixels of the square around each pixel; what lies outside is off."""
    return F.sum("_row").over(column().rowsBetween(-radius, radius))


def binary_filter(raster: DataFrame, radius: int, least: int) -> DataFrame:
    on = raster.withColumn("_row", F.sum((F.col("on") > 0).cast("bigint")).over(row().rowsBetween(-radius, radius)))
    return on.withColumn("on", F.when(counted(on, radius) >= least, 255).otherwise(0).cast("bigint")).drop("_row")


def dilate(raster: DataFrame, radius: int) -> DataFrame:
    return binary_filter(raster, radius, 1)


def erode(raster: DataFrame, radius: int) -> DataFrame:
    return binary_filter(raster, radius, (2 * radius + 1) ** 2)


def opened(raster: DataFrame, radius: int) -> DataFrame:
    return dilate(erode(raster, radius), radius)


def closed(raster: DataFrame, radius: int) -> DataFrame:
    return erode(dilate(raster, radius), radius)


def lines(raster: DataFrame, least: int) -> DataFrame:
    """Maximal runs of at least so many on pixels, along rows, columns and both diagonals (starts at the least x; for columns the least y)."""
    on = raster.where("on > 0").withColumns({"down": F.col("x") - F.col("y"), "up": F.col("x") + F.col("y")})
    out = None
    for name, line, at in (("horizontal", "y", "x"), ("vertical", "x", "y"), ("down-diagonal", "down", "x"), ("up-diagonal", "up", "x")):
        island = F.col(at) - F.row_number().over(Window.partitionBy("raster_id", line).orderBy(at))
        runs = on.withColumn("_island", island).groupBy("raster_id", line, "_island").agg(F.count("*").alias("length"), F.min(F.struct(F.col(at).alias("at"), "x", "y")).alias("s")).where(F.col("length") >= least)
        runs = runs.select("raster_id", F.lit(name).alias("orientation"), F.col("s.x").alias("x"), F.col("s.y").alias("y"), "length")
        out = runs if out is None else out.unionByName(runs)
    return out


def halved(raster: DataFrame) -> DataFrame:
    """The next pyramid level: the top-left pixel of every 2 x 2 block."""
    return raster.where("x % 2 = 0 and y % 2 = 0").select("raster_id", F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x"), "v")


def cropped(raster: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """The pixels of a rectangle, moved to its corner."""
    inside = F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)
    return raster.where(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def flipped(raster: DataFrame) -> DataFrame:
    """Rows in opposite order, by the height of each raster."""
    heights = raster.groupBy("raster_id").agg(F.max("y").alias("_last"))
    return raster.join(heights, "raster_id").withColumn("y", F.col("_last") - F.col("y")).drop("_last")


def placed(tiles: DataFrame, offsets: DataFrame, canvas: DataFrame) -> DataFrame:
    """canvas (y, x, v) with the pixels of tiles (raster_id, y, x, v) put at offsets (raster_id, dx, dy).

    Where tiles overlap, the one with the greatest raster_id is on top; what lies outside the canvas is cut off.
    """
    moved = tiles.join(offsets, "raster_id").select((F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), F.struct("raster_id", F.col("v").alias("top")).alias("_p"))
    on_top = moved.groupBy("y", "x").agg(F.max("_p")["top"].alias("_top"))
    return canvas.join(on_top, ["y", "x"], "left").select("y", "x", F.coalesce("_top", "v").alias("v"))


def transitions(raster: DataFrame) -> DataFrame:
    """Distinct values, changes to the right and down, and on pixels in millionths, of each raster."""
    changed = lambda w: (F.lead("on", 1).over(w) != F.col("on")).cast("bigint")
    marks = raster.withColumns({"right": changed(row()), "down": changed(column())})
    pairs = F.count("right") + F.count("down")
    return marks.groupBy("raster_id").agg(F.countDistinct("v").alias("colours"), F.expr("(sum(right) + sum(down)) * 1000000").alias("_t"), pairs.alias("pairs"), F.expr("count_if(on > 0) * 1000000 div count(*)").alias("foreground_ppm")).select("raster_id", "colours", F.expr("_t div pairs").alias("transition_ppm"), "foreground_ppm")
