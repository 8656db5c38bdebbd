"""Vectors, small rasters against brute force, and the stream against its batch form."""

import random

import pytest
from pyspark.sql import functions as F

from loamgrid.functions import intmath
from loamgrid.operators import checks, pyramid, raster
from loamgrid.streaming import readiness


def test_hash_vectors(spark):
    row = spark.createDataFrame([("", 1), ("unknown:0:0", 42)], "k string, n bigint").select(intmath.fnv1a64(F.col("k")).alias("h"), intmath.u64(intmath.mix64(F.col("n"))).alias("m"), intmath.variation(F.col("n"), 7).alias("v")).collect()
    assert [int(r["h"]) for r in row] == [14695981039346656037, 14471064896764214953]
    assert [int(r["m"]) for r in row] == [6238072747940578789, 12058926934050108962]
    assert row[1]["v"] == 2


def test_division(spark):
    r = spark.range(1).select(intmath.div(F.lit(-7), 2).alias("d"), intmath.floor_div(F.lit(-7), 2).alias("f")).first()
    assert (r["d"], r["f"]) == (-3, -4)


def long(spark, grid):
    return spark.createDataFrame([(0, y, x, int(v), 255 if v else 0) for y, row in enumerate(grid) for x, v in enumerate(row)], "raster_id bigint, y bigint, x bigint, v bigint, on bigint")


def test_scharr_step(spark):
    step = long(spark, [[1000 if x < 2 else 2000 for x in range(5)] for _ in range(5)])
    assert raster.scharr(step).where("y = 2 and x = 2").first()["magnitude"] == 16000


@pytest.mark.parametrize("radius", [1, 2])
def test_morphology_against_brute_force(spark, radius):
    rng = random.Random(radius)
    grid = [[rng.random() < 0.6 for _ in range(9)] for _ in range(7)]
    on = lambda y, x: 0 <= y < 7 and 0 <= x < 9 and grid[y][x]
    near = lambda y, x: [on(y + a, x + b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]
    for f, test in ((raster.dilate, any), (raster.erode, all)):
        got = {(r["y"], r["x"]): r["on"] > 0 for r in f(long(spark, grid), radius).collect()}
        assert got == {(y, x): test(near(y, x)) for y in range(7) for x in range(9)}


def test_lines_of_a_cross(spark):
    cross = long(spark, [[x == y or x + y == 4 for x in range(5)] for y in range(5)])
    assert sorted((r["orientation"], r["x"], r["y"], r["length"]) for r in raster.lines(cross, 5).collect()) == [("down-diagonal", 0, 0, 5), ("up-diagonal", 0, 4, 5)]


def test_levels(spark):
    got = pyramid.levels(spark.createDataFrame([(1, 5, 3), (2, 7623, 3325)], "id bigint, width bigint, height bigint"))
    assert [(r["width"], r["height"]) for r in got.where("id = 1").orderBy("level").collect()] == [(1, 1), (2, 1), (3, 2), (5, 3)]
    big = pyramid.tiles(got.where("id = 2"), 512)
    assert (big.count(), big.where("level = 13").count(), big.select("level").distinct().count()) == (157, 105, 14)


def test_crop_flip_and_blit(spark):
    grid = long(spark, [[10 * y + x for x in range(4)] for y in range(3)])
    value = lambda df: {(r["y"], r["x"]): r["v"] for r in df.collect()}
    assert value(raster.cropped(grid, 1, 1, 2, 5)) == {(0, 0): 11, (0, 1): 12, (1, 0): 21, (1, 1): 22}
    assert value(raster.flipped(grid)) == {(2 - y, x): 10 * y + x for y in range(3) for x in range(4)}
    assert raster.flipped(grid.limit(0)).count() == 0
    tiles = spark.createDataFrame([(r, 0, x, 100 * r + x) for r in (1, 2) for x in (0, 1)], "raster_id bigint, y bigint, x bigint, v bigint")
    canvas = spark.createDataFrame([(0, x, -1) for x in range(4)], "y bigint, x bigint, v bigint")
    at = spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "raster_id bigint, dx bigint, dy bigint")
    assert value(raster.placed(tiles, at, canvas)) == {(0, 0): 100, (0, 1): 200, (0, 2): 201, (0, 3): -1}


def test_parents(spark):
    tiles = pyramid.tiles(pyramid.levels(spark.createDataFrame([(1, 1500, 600)], "id bigint, width bigint, height bigint")), 512)
    top = {(r["col"], r["row"]): (r["children"], r["quarters"]) for r in pyramid.parents(tiles).where("level = 10").collect()}
    assert top == {(0, 0): (4, 15), (1, 0): (2, 5)}


def test_violations(spark):
    rows = spark.createDataFrame([("a", "0" * 64, 1, "f.bin", "CC0"), ("b", "X", 0, "../f", " "), ("b", None, 1, "f", "CC0")], "id string, sha256 string, size_bytes bigint, filename string, license string")
    got = {(r["key"], r["check_id"]) for r in checks.source_lock(rows).collect()}
    assert got == {("b", c) for c in ("digest", "size", "unique", "filename", "licence")}


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    kinds = ["view", "click", "signup", "purchase", "purchase", "purchase", "purchase", "purchase", "click", "click"]
    # Scenes 2 and 3 fail half way; batches end in the middle of runs.
    kind = lambda i: "error" if i in (400, 401) else rng.choice(kinds)
    rows = [(i, f"2024-01-01 {i // 120:02d}:{i // 2 % 60:02d}:{i % 2 * 30:02d}", i % 5, kind(i), rng.random() * 1.2) for i in range(900)]
    events = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    for at in range(0, 900, 100):
        events.where(F.col("event_id").between(at, at + 99)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = readiness.frames_stream(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("frames_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {tuple(r) for r in spark.sql("select event_id, user_id, stable, ready from frames_out").collect()}
    assert got == {tuple(r) for r in readiness.frames(events).collect()} and {r[3] for r in got} == {True, False}
    assert sum(p["numInputRows"] > 0 for p in run.recentProgress) >= 9
