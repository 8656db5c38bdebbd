"""Per-cell evidence from imagery samples and classified points, and the classification cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions.intmath import floor_div


BANDS = ("red", "green", "blue", "nir")


def basis_points(part: Column, whole: Column) -> Column:
    """part / whole in hundredths of a percent, 0 of nothing, at most 10000."""
    return F.when(whole == 0, 0).otherwise(F.least(floor_div(part * 10000, F.greatest(whole, F.lit(1))), F.lit(10000))).cast("bigint")


def imagery(samples: DataFrame) -> DataFrame:
    """Samples, green and dark-water samples of each cell."""
    green = (F.col("nir") - F.col("red")) * 10 >= F.col("nir") + F.col("red")
    dark = (F.col("nir") < 55) & (F.col("red") + F.col("green") + F.col("blue") < 180)
    return samples.groupBy("col", "row").agg(F.count("*").alias("samples"), F.count_if(green & (F.col("nir") + F.col("red") > 0)).alias("green_samples"), F.count_if(dark).alias("dark_samples"), *[F.sum(b).cast("bigint").alias(f"{b}_sum") for b in BANDS])


def imagery_by_cell(samples: DataFrame) -> DataFrame:
    """Counts of imagery() and the sums of the four bands of each cell."""
    return imagery(samples).withColumnsRenamed({f"{b}_sum": b for b in BANDS})


def cloud(points: DataFrame) -> DataFrame:
    """Point counts by class, lowest ground and highest vegetation of each cell."""
    cls, n = F.col("class"), lambda *c: F.count_if(F.col("class").isin(*c))
    return points.groupBy("col", "row").agg(F.count("*").alias("all_points"), n(2).alias("ground"), n(3, 4, 5).alias("low_to_high"), n(4, 5).alias("vegetation"), n(6).alias("building"), n(9).alias("water"), n(2, 3, 4, 5, 6, 9).alias("lidar_samples"), F.min(F.when(cls == 2, F.col("z"))).alias("ground_z"), F.max(F.when(cls.isin(4, 5), F.col("z"))).alias("canopy_z"))


def height_bins(points: DataFrame) -> DataFrame:
    """Unclassified points of each cell by half-metre bin of height, 0..255."""
    at = F.least(F.greatest(floor_div("z", 500), F.lit(0)), F.lit(255)).alias("bin")
    return points.where(F.col("class") == 1).groupBy("col", "row", at).agg(F.count("*").alias("n"))


def transients(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Unclassified points from 0.5 m to 4 m above the ground, by half-metre bins 0..255, of each cell."""
    near = height_bins(points).join(cells.select("col", "row", "ground_z"), ["col", "row"]).where(F.col("bin").between(floor_div(F.col("ground_z") + 500, 500), floor_div(F.col("ground_z") + 4000, 500)))
    return near.groupBy("col", "row").agg(F.sum("n").alias("transient_points"))


def gathered(points: DataFrame) -> DataFrame:
    """Everything classify() needs of a cell, in one pass over the points.

    Counts are first made for each cell and height bin of unclassified points, on the map side, then added up for the
    cell, whose bins (257 at most) are at hand to be held against its ground.
    """
    cls, n = F.col("class"), lambda *c: F.count_if(F.col("class").isin(*c))
    green = ((F.col("nir") - F.col("red")) * 10 >= F.col("nir") + F.col("red")) & (F.col("nir") + F.col("red") > 0)
    dark = (F.col("nir") < 55) & (F.col("red") + F.col("green") + F.col("blue") < 180)
    at = F.when(cls == 1, F.least(F.greatest(floor_div("z", 500), F.lit(0)), F.lit(255)))
    counts = {"all_points": F.count("*"), "vegetation": n(4, 5), "building": n(6), "water": n(9), "lidar_samples": n(2, 3, 4, 5, 6, 9), "green_samples": F.count_if(green), "dark_samples": F.count_if(dark)}
    binned = points.groupBy("col", "row", at.alias("bin")).agg(*[c.alias(k) for k, c in counts.items()], F.min(F.when(cls == 2, F.col("z"))).alias("ground_z"), F.max(F.when(cls.isin(4, 5), F.col("z"))).alias("canopy_z"))
    bins = F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", F.col("all_points").alias("n"))))
    cells = binned.groupBy("col", "row").agg(*[F.sum(k).cast("bigint").alias(k) for k in counts], F.min("ground_z").alias("ground_z"), F.max("canopy_z").alias("canopy_z"), bins.alias("bins"))
    low, high = floor_div(F.col("ground_z") + 500, 500), floor_div(F.col("ground_z") + 4000, 500)
    near = F.aggregate("bins", F.lit(0).cast("bigint"), lambda s, b: s + F.when(b["bin"].between(low, high), b["n"]).otherwise(0))
    return cells.withColumn("transient_points", near).drop("bins")


def classify(points: DataFrame) -> DataFrame:
    """One row for each cell with its evidence and class, in one pass over the points, which are samples of imagery too."""
    bp = lambda part: basis_points(F.col(part), F.col("all_points"))
    cells = gathered(points).withColumns({"building_bp": bp("building"), "water_bp": bp("water"), "vegetation_bp": bp("vegetation"), "green_bp": bp("green_samples"), "dark_bp": bp("dark_samples")})
    name = F.when(F.col("building_bp") >= 7000, "unknown").when((F.col("water_bp") >= 2500) | (F.col("dark_bp") >= 7000), "water").when((F.col("vegetation_bp") >= 800) & (F.col("vegetation") >= 20), "vegetation").when(F.col("green_bp") >= 4500, "grass").otherwise("dry")
    return cells.select("col", "row", name.alias("class"), "building_bp", "water_bp", "vegetation_bp", "green_bp", "dark_bp", "lidar_samples", "transient_points", "ground_z", "canopy_z")


def shares(cells: DataFrame) -> DataFrame:
    """Cells of each class and their share in millionths; a window over the few classes gives the whole."""
    n = cells.groupBy("class").agg(F.count("*").alias("n"))
    return n.withColumn("_all", F.sum("n").over(Window.partitionBy())).select("class", "n", F.expr("n * 1000000 div _all").alias("ppm"))
