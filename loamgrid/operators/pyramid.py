"""Tile pyramids: levels, tile grids and ordered hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def levels(images: DataFrame) -> DataFrame:
    """id, level, width, height: from 1 x 1 up to the full size, each half the next one, rounded up."""
    size = F.greatest("width", "height")
    top = F.ceil(F.log2(size)).cast("int")
    top = F.when(F.expr("shiftleft(1l, ceil(log2(greatest(width, height)))::int - 1)") >= size, top - 1).otherwise(top)  # a double's rounding
    each = images.withColumn("top", F.when(size <= 1, 0).otherwise(top)).select("*", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("level"))
    down = lambda c: F.expr(f"({c} + shiftleft(1l, top - level) - 1) div shiftleft(1l, top - level)")
    return each.select("id", "level", down("width").alias("width"), down("height").alias("height"))


def tiles(levels: DataFrame, side: int) -> DataFrame:
    """A row for each tile of each level with its pixel size."""
    count = lambda c: F.expr(f"({c} + {side} - 1) div {side} - 1")
    cut = levels.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), count("width"))).alias("col")).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), count("height"))).alias("row"))
    size = lambda whole, at: F.least(F.lit(side), F.col(whole) - F.col(at) * side).cast("bigint")
    return cut.select("id", "level", "col", "row", size("width", "col").alias("width"), size("height", "row").alias("height"))


def set_hash(tiles: DataFrame) -> DataFrame:
    """SHA-256 of 'level/column_row NUL digest LF' over each set's tiles by level, row and column; their number and bytes.

    The digest is over one text by definition; a set is the tiles of one image, which its largest side bounds.
    """
    lines = F.array_sort(F.collect_list(F.struct("level", "row", "col", "sha256")))
    text = F.array_join(F.transform(lines, lambda r: F.concat(r["level"].cast("string"), F.lit("/"), r["col"].cast("string"), F.lit("_"), r["row"].cast("string"), F.lit("\0"), r["sha256"], F.lit("\n"))), "")
    return tiles.groupBy("set_id").agg(F.sha2(text, 256).alias("set_sha256"), F.count("*").alias("n"), F.sum("bytes").cast("bigint").alias("bytes"))


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Tiles on one side only; none means that the sets are equal."""
    keys = ["id", "level", "col", "row"]
    both = expected.select(*keys, F.lit(True).alias("e")).join(actual.select(*keys, F.lit(True).alias("a")), keys, "full_outer")
    return both.where("e is null or a is null").select(*keys, F.when(F.col("a").isNull(), "missing").otherwise("unexpected").alias("problem"))


def parents(tiles: DataFrame) -> DataFrame:
    """level, col and row of every tile's parent, the number of its children and the mask of the quarters they fill."""
    quarter = (F.col("row") % 2 * 2 + F.col("col") % 2).cast("int")
    keyed = tiles.where("level > 0").select("id", (F.col("level") - 1).alias("level"), F.expr("col div 2").alias("col"), F.expr("row div 2").alias("row"), F.expr("1L").alias("one"), quarter.alias("quarter"))
    return keyed.groupBy("id", "level", "col", "row").agg(F.sum("one").alias("children"), F.bit_or(F.call_function("shiftleft", F.col("one"), F.col("quarter"))).alias("quarters"))
