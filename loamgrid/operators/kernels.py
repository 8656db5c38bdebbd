"""Neighbourhood kernels on long rasters (raster_id, y, x): gradients, edges, components, distances, watersheds.

Neighbours come from windows along rows, columns and diagonals. Components and floods join runs of pixels until nothing
changes; the watershed works on whole rasters of bounded sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions.durable import components

#: Fixed value: the distance of a pixel in a raster without sources.
NOWHERE = 1_073_741_823
#: Costs of a straight and of a diagonal step.
STRAIGHT, DIAGONAL = 3, 4


def along(line: str):
    """A window along 'row', 'column', 'down' (x - y constant) or 'up' (x + y constant)."""
    key, order = {"row": (F.col("y"), "x"), "column": (F.col("x"), "y"), "down": (F.col("x") - F.col("y"), "x"), "up": (F.col("x") + F.col("y"), "x")}[line]
    return Window.partitionBy("raster_id", key).orderBy(order)


def before(c: str | Column, line: str, default=None) -> Column:
    return F.lag(c, 1, default).over(along(line))


def after(c: str | Column, line: str, default=None) -> Column:
    return F.lead(c, 1, default).over(along(line))


def gradient(raster: DataFrame) -> DataFrame:
    """magnitude and direction of the 3-10-3 gradient of v where the 3 x 3 neighbourhood is covered; else 0, horizontal.

    raster: raster_id, y, x, v and covered (boolean), every pixel of a grid once. Directions are horizontal, vertical,
    down and up, by slopes of 1:2 and 2:1; equal signs of both components, none too, are down.
    """
    sides = ["v", F.col("covered").cast("int")]
    l_v, r_v = (f(sides[0], "row") for f in (before, after))
    whole = F.coalesce(before(sides[1], "row"), F.lit(0)) + sides[1] + F.coalesce(after(sides[1], "row"), F.lit(0))
    rows = raster.withColumns({"_a": r_v - l_v, "_b": 3 * l_v + 10 * F.col("v") + 3 * r_v, "_n": whole})
    n = F.coalesce(before("_n", "column"), F.lit(0)) + F.col("_n") + F.coalesce(after("_n", "column"), F.lit(0))
    both = rows.withColumns({"_dx": 3 * before("_a", "column") + 10 * F.col("_a") + 3 * after("_a", "column"), "_dy": after("_b", "column") - before("_b", "column"), "_all": n == 9})
    dx, dy = (F.when(F.col("_all"), F.col(c)).otherwise(0) for c in ("_dx", "_dy"))
    return both.select("raster_id", "y", "x", (F.abs(dx) + F.abs(dy)).cast("bigint").alias("magnitude"), F.when(F.col("_all"), quantized(F.col("_dx"), F.col("_dy"))).otherwise("horizontal").alias("direction"))


def quantized(dx: Column, dy: Column) -> Column:
    return F.when(F.abs(dy) * 2 < F.abs(dx), "horizontal").when(F.abs(dx) * 2 < F.abs(dy), "vertical").when(F.signum(dx) == F.signum(dy), "down").otherwise("up")


def ridges(gradients: DataFrame) -> DataFrame:
    """gradients with ridge: whether magnitude is not below either neighbour along its direction; outside is 0."""
    at = {"horizontal": "row", "vertical": "column", "down": "down", "up": "up"}
    sides = {f"_{d}": F.greatest(before("magnitude", line, 0), after("magnitude", line, 0)) for d, line in at.items()}
    most = F.coalesce(*[F.when(F.col("direction") == d, F.col(f"_{d}")) for d in at])
    return gradients.withColumns(sides).withColumn("ridge", F.col("magnitude") >= most).drop(*sides)


def normal_steps(raster: DataFrame) -> DataFrame:
    """step: the greatest squared distance of (r, g, b) between a covered pixel and its covered neighbours; else 0."""
    value = F.when(F.col("covered"), F.struct("r", "g", "b"))
    given = raster.withColumn("_v", value)
    near = [f("_v", line) for line in ("row", "column", "down", "up") for f in (before, after)]
    square = lambda n: F.coalesce(sum(((n[c] - F.col(c)) * (n[c] - F.col(c)) for c in "rgb"), F.lit(0)), F.lit(0))
    steps = given.withColumns({f"_s{i}": square(n) for i, n in enumerate(near)})
    return steps.select("raster_id", "y", "x", F.when(F.col("covered"), F.greatest(*[f"_s{i}" for i in range(8)])).otherwise(0).cast("bigint").alias("step"))


def runs(on: DataFrame) -> DataFrame:
    """Runs of pixels (raster_id, y, x) along rows: raster_id, y, x0, x1."""
    island = F.col("x") - F.row_number().over(along("row"))
    return on.withColumn("_i", island).groupBy("raster_id", "y", "_i").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_i")


def labelled_runs(on: DataFrame, reach: int = 1) -> DataFrame:
    """runs() with comp, one number for each component; reach 1 joins over corners too, 0 over sides only.

    Runs are the nodes, so that work goes with edges of shapes and not with their areas. Runs and pixels are made out of few
    rows, whose size says nothing of theirs, so no side of a join is sent whole, here and in what follows.
    """
    key = lambda a: F.struct(F.col(f"{a}.raster_id").alias("raster_id"), F.col(f"{a}.y").alias("y"), F.col(f"{a}.x0").alias("x"))
    found = runs(on)
    upper, lower = found.alias("u"), found.withColumn("y", F.col("y") - 1).alias("l")
    touch = upper.join(lower.hint("merge"), (F.col("u.raster_id") == F.col("l.raster_id")) & (F.col("u.y") == F.col("l.y")) & (F.col("u.x0") <= F.col("l.x1") + reach) & (F.col("l.x0") <= F.col("u.x1") + reach))
    down = F.struct(F.col("l.raster_id").alias("raster_id"), (F.col("l.y") + 1).alias("y"), F.col("l.x0").alias("x"))
    own = found.alias("s").select(key("s").alias("a"), key("s").alias("b"))
    comps = components(touch.select(key("u").alias("a"), down.alias("b")).unionByName(own))
    named = comps.select("node.raster_id", "node.y", F.col("node.x").alias("x0"), "comp")
    return found.join(named.hint("merge"), ["raster_id", "y", "x0"])


def component_table(labelled: DataFrame) -> DataFrame:
    """raster_id, label (from 1, by first pixel in row order), area and box of each component of labelled_runs()."""
    each = labelled.groupBy("raster_id", "comp").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("bigint").alias("area"), F.min("x0").alias("min_x"), F.min("y").alias("min_y"), F.max("x1").alias("max_x"), F.max("y").alias("max_y"))
    order = Window.partitionBy("raster_id").orderBy("comp.y", "comp.x")  # the least run of a component holds its first pixel
    return each.withColumn("label", F.row_number().over(order).cast("bigint"))


def labelled_pixels(labelled: DataFrame) -> DataFrame:
    """raster_id, y, x and label of every pixel of labelled_runs()."""
    named = labelled.join(component_table(labelled).select("raster_id", "comp", "label").hint("merge"), ["raster_id", "comp"])
    return named.select("raster_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "label")


def hysteresis(gradients: DataFrame, low: int, high: int) -> DataFrame:
    """on: 255 for ridges of at least low that hang together, over corners too, with one of at least high; else 0."""
    kept = ridges(gradients).where(F.col("ridge") & (F.col("magnitude") >= low))
    labelled = labelled_runs(kept.select("raster_id", "y", "x"))
    pixels = labelled.select("raster_id", "y", "comp", F.explode(F.sequence("x0", "x1")).alias("x"))
    strong = pixels.join(kept.where(F.col("magnitude") >= high).select("raster_id", "y", "x").hint("merge"), ["raster_id", "y", "x"]).select("comp").distinct()
    edges = pixels.join(strong.hint("merge"), "comp", "left_semi").select("raster_id", "y", "x", F.lit(255).cast("bigint").alias("_on"))
    return gradients.join(edges.hint("merge"), ["raster_id", "y", "x"], "left").select("raster_id", "y", "x", F.coalesce("_on", F.lit(0)).cast("bigint").alias("on"))


def chamfer(raster: DataFrame) -> DataFrame:
    """distance of every pixel (every pixel of a grid once) from the nearest with on > 0, in steps of 3 and 4.

    A shortest way can take its diagonal steps first, all one way, and then its straight ones along one axis. So two windows
    along the diagonals and two along rows and columns find it, without going round.
    """
    first = raster.withColumn("_d", F.when(F.col("on") > 0, 0).cast("bigint"))

    def spread(c: str, line: str, cost: int) -> Column:
        pos = F.col("y") if line == "column" else F.col("x")
        back = F.min(F.col(c) - cost * pos).over(along(line).rowsBetween(Window.unboundedPreceding, 0)) + cost * pos
        forth = F.min(F.col(c) + cost * pos).over(along(line).rowsBetween(0, Window.unboundedFollowing)) - cost * pos
        return F.least(back, forth)

    slanted = first.withColumn("_down", spread("_d", "down", DIAGONAL)).withColumn("_up", spread("_d", "up", DIAGONAL)).withColumn("_e", F.least("_down", "_up"))
    straight = slanted.withColumn("_row", spread("_e", "row", STRAIGHT)).withColumn("_col", spread("_e", "column", STRAIGHT))
    return straight.select("raster_id", "y", "x", F.coalesce(F.least("_row", "_col"), F.lit(NOWHERE)).cast("bigint").alias("distance"))
