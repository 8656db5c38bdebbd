"""Publication of pictures as pyramids of binary tiles, level by level.

A level's tiles are made from the four child tiles of the level below it, which are read back from where that level was
written. A level is finished once its table is committed; a run that was cut off goes on from the last finished one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.operators import pyramid

TILE = "id bigint, level int, col bigint, row bigint, width bigint, height bigint, pixels binary"
#: What a tile file begins with, and the length of its header with width and height (unsigned, little-endian).
MAGIC, HEADER = b"ISIDX1\0\0", 16


def shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each tile's own part of its parent: every second pixel of every second row."""
    for batch in batches:
        rows = []
        for w, h, pixels in zip(batch.column("width").to_pylist(), batch.column("height").to_pylist(), batch.column("pixels"), strict=True):
            rows.append(np.frombuffer(pixels.as_buffer(), np.uint8).reshape(h, w)[::2, ::2].tobytes())
        quarter = [(w + 1) // 2 for w in batch.column("width").to_pylist()], [(h + 1) // 2 for h in batch.column("height").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "level", "col", "row")] + [pa.array(quarter[0], pa.int64()), pa.array(quarter[1], pa.int64()), pa.array(rows, pa.binary())], ["id", "level", "col", "row", "width", "height", "pixels"])


def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One tile from the parts of its children, four at most."""
    for batch in batches:
        sizes, out = [], []
        for parts in batch.column("parts").to_pylist():
            grid = {(p["row"] % 2, p["col"] % 2): np.frombuffer(p["pixels"], np.uint8).reshape(p["height"], p["width"]) for p in parts}
            lines = [np.concatenate([grid[r, c] for c in (0, 1) if (r, c) in grid], axis=1) for r in (0, 1) if (r, 0) in grid]
            whole = np.concatenate(lines, axis=0)
            sizes.append(whole.shape)
            out.append(whole.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "level", "col", "row")] + [pa.array([s[1] for s in sizes], pa.int64()), pa.array([s[0] for s in sizes], pa.int64()), pa.array(out, pa.binary())], ["id", "level", "col", "row", "width", "height", "pixels"])


def reduced(tiles: DataFrame) -> DataFrame:
    """The next smaller level of tiles of one level: the top-left pixel of every 2 x 2 block, from four child tiles at most.

    Tiles have an even side but at the right and lower border. A quarter of each tile's pixels is shuffled.
    """
    part = F.struct("row", "col", "width", "height", "pixels")
    parents = tiles.select(*TILE_COLUMNS).mapInArrow(shrunk, TILE).groupBy("id", (F.col("level") - 1).cast("int").alias("level"), F.expr("col div 2").alias("pc"), F.expr("row div 2").alias("pr")).agg(F.collect_list(part).alias("parts"))
    return parents.withColumnsRenamed({"pc": "col", "pr": "row"}).mapInArrow(stitched, TILE)


TILE_COLUMNS = ["id", "level", "col", "row", "width", "height", "pixels"]


def finished(spark: SparkSession, path: str) -> bool:
    """Whether the table at path was committed."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def encoded(tiles: DataFrame) -> DataFrame:
    """tiles with file, the bytes of each tile's file, its sha256 and bytes, their number."""
    little = lambda c: F.unhex(F.regexp_replace(F.format_string("%08x", c), "(..)(..)(..)(..)", "$4$3$2$1"))
    head = F.concat(F.unhex(F.lit(MAGIC.hex())), little("width"), little("height"))
    return tiles.withColumn("file", F.concat(head, "pixels")).withColumns({"sha256": F.sha2("file", 256), "bytes": F.length("file").cast("bigint")})


def publish(tiles: DataFrame, sizes: DataFrame, side: int, path: str) -> DataFrame:
    """Writes the pyramids of pictures under path and returns their tiles: id, level, col, row, width, height, pixels.

    tiles: id, col, row, width, height and pixels of the full pictures, cut into tiles of side (even) pixels. sizes: id,
    width and height of each picture. Levels go from each picture's largest down to 1 x 1 at level 0, so pictures of
    different sizes reach a level in different rounds. Finished levels found under path are not made again.
    """
    if side % 2:
        raise ValueError("tiles that are reduced need an even side")
    spark = tiles.sparkSession
    top = pyramid.levels(sizes).groupBy("id").agg(F.max("level").alias("level"))
    first = tiles.join(top, "id").select(*TILE_COLUMNS)
    most = top.agg(F.max("level")).first()[0]
    at = lambda level: f"{path}/level={level}"
    for level in range(-1 if most is None else most, -1, -1):
        if finished(spark, at(level)):
            continue
        rows = first.where(F.col("level") == level)
        if level < most:
            rows = rows.unionByName(reduced(spark.read.schema(TILE).parquet(at(level + 1))))
        rows.write.mode("overwrite").parquet(at(level))  # what a broken run has left there is not committed
    if most is None:
        return spark.createDataFrame([], TILE)
    return spark.read.schema(TILE).parquet(*[at(level) for level in range(most + 1)])


def release(tiles: DataFrame) -> DataFrame:
    """id, set_sha256 (of the lines of all tiles, in order), n and bytes of each published picture."""
    return pyramid.set_hash(encoded(tiles).withColumnRenamed("id", "set_id")).withColumnRenamed("set_id", "id")
