"""Geospatial inputs derived from the driver's tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point cloud with four-band samples: x, y, z (mm), cell (col, row), class and red, green, blue, nir."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    df = df.select(
        ((F.col("l_partkey") * 7919 + F.col("l_orderkey") * 104729 + F.col("l_linenumber") * 1299709) % 620000).alias("x"),
        ((F.col("l_orderkey") * 6151 + F.col("l_suppkey") * 3079 + F.col("l_partkey") * 50021) % 620000).alias("y"),
        (F.col("l_quantity").cast("bigint") * 250).alias("z"), (F.col("l_orderkey") % 10).alias("o"), "l_orderkey", "l_partkey", "l_suppkey",
    )
    df = df.withColumns({"col": F.expr("x div 20000"), "row": F.expr("y div 20000")}).withColumn("kind", (F.col("col") * 7 + F.col("row") * 13) % 6)
    kind, o = F.col("kind"), F.col("o")
    cls = F.when((kind == 0) & (o < 8), 6).when((kind == 1) & (o < 4), 9).when((kind == 2) & (o < 6), 4 + o % 2).when(o < 7, 2).when(o < 8, 3).otherwise(1)
    band = lambda key, dark, bright: F.when(kind == 5, F.col(key) % dark).otherwise(F.col(key) % bright)
    return df.select(
        "x", "y", "z", "col", "row", cls.cast("int").alias("class"), band("l_partkey", 50, 200).alias("red"), band("l_suppkey", 60, 256).alias("green"), band("l_orderkey", 60, 256).alias("blue"),
        F.when(kind == 5, F.col("l_orderkey") % 50).when(kind == 3, 100 + F.col("l_orderkey") % 156).otherwise(F.col("l_orderkey") % 120).alias("nir"),
    )


POINTS_SQL = """pts AS (SELECT x, y, z, x // 20000 AS col, y // 20000 AS row, o, k.l_partkey, k.l_suppkey, k.l_orderkey, ((x // 20000) * 7 + (y // 20000) * 13) % 6 AS kind FROM
  (SELECT *, (l_partkey * 7919 + l_orderkey * 104729 + l_linenumber * 1299709) % 620000 AS x, (l_orderkey * 6151 + l_suppkey * 3079 + l_partkey * 50021) % 620000 AS y,
   l_quantity::BIGINT * 250 AS z, l_orderkey % 10 AS o FROM lineitem) k),
cloud AS (SELECT x, y, z, col, row, CASE WHEN kind = 0 AND o < 8 THEN 6 WHEN kind = 1 AND o < 4 THEN 9 WHEN kind = 2 AND o < 6 THEN 4 + o % 2 WHEN o < 7 THEN 2 WHEN o < 8 THEN 3 ELSE 1 END AS class,
  CASE WHEN kind = 5 THEN l_partkey % 50 ELSE l_partkey % 200 END AS red, CASE WHEN kind = 5 THEN l_suppkey % 60 ELSE l_suppkey % 256 END AS green,
  CASE WHEN kind = 5 THEN l_orderkey % 60 ELSE l_orderkey % 256 END AS blue, CASE WHEN kind = 5 THEN l_orderkey % 50 WHEN kind = 3 THEN 100 + l_orderkey % 156 ELSE l_orderkey % 120 END AS nir FROM pts)"""


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long rasters raster_id, y, x, v (scaled vector components) with on = 255 or 0 (unique raster_id, y, x)."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "e"))
    v = F.floor((F.col("e").cast("double") + 1) * 1000)
    return df.select(F.expr("vec_id div 64").alias("raster_id"), (F.col("vec_id") % 64).alias("y"), F.col("pos").cast("bigint").alias("x"), v.alias("v"), F.when(v > 1000, 255).otherwise(0).cast("bigint").alias("on"))


RASTERS_SQL = """cellsr AS (SELECT vec_id // 64 AS raster_id, vec_id % 64 AS y, unnest(range(len(embedding))) AS x, unnest(embedding) AS e FROM embeddings),
ras AS (SELECT raster_id, y, x, floor((e::DOUBLE + 1) * 1000)::BIGINT AS v, CASE WHEN floor((e::DOUBLE + 1) * 1000) > 1000 THEN 255 ELSE 0 END::BIGINT AS on_ FROM cellsr)"""


def mask_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask pixels: class 0..23, evidence bits and instance (the class's own when there is one)."""
    df = table(spark, sf_dir, "lineitem")
    cls = F.col("l_partkey") % 24
    # One supplier in fifty has instances that several classes share.
    own = F.when(F.col("l_suppkey") % 50 == 7, 0).otherwise(cls)
    return df.select(cls.alias("class"), (F.col("l_orderkey") % 256).alias("evidence"), F.when(F.col("l_suppkey") % 3 == 0, 0).otherwise(F.col("l_suppkey") % 50 * 24 + own).alias("instance"))


MASK_SQL = "mask AS (SELECT l_partkey % 24 AS class, l_orderkey % 256 AS evidence, CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_suppkey % 50 * 24 + CASE WHEN l_suppkey % 50 = 7 THEN 0 ELSE l_partkey % 24 END END AS instance FROM lineitem)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World objects: id, class, min/max x, y (mm), z and height, from parts."""
    df = table(spark, sf_dir, "part")
    x, y, half = F.col("p_partkey") * 7919 % 600000, F.col("p_partkey") * 50021 % 600000, F.col("p_size").cast("bigint") * 400 + 500
    return df.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 9).alias("class"), (x - half).alias("min_x"), (x + half).alias("max_x"), (y - half).alias("min_y"), (y + half).alias("max_y"), F.lit(0).cast("bigint").alias("min_z"), (F.col("p_size").cast("bigint") * 300).alias("height"))


BOXES_SQL = """boxes AS (SELECT p_partkey AS id, p_partkey % 9 AS class, x - h AS min_x, x + h AS max_x, y - h AS min_y, y + h AS max_y, 0::BIGINT AS min_z, p_size::BIGINT * 300 AS height FROM
  (SELECT *, p_partkey * 7919 % 600000 AS x, p_partkey * 50021 % 600000 AS y, p_size::BIGINT * 400 + 500 AS h FROM part))"""


def ring_of(box: str = "") -> Column:
    """The closed counter-clockwise ring of a box's columns."""
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return F.array(at("min_x", "min_y"), at("max_x", "min_y"), at("max_x", "max_y"), at("min_x", "max_y"), at("min_x", "min_y"))
