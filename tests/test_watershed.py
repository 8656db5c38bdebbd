"""Watersheds by tiles against one flood with a queue."""

import heapq
import random

import pytest

from loamgrid.operators import watershed as w


def flooded(pixels):
    """Labels of {(y, x): (v, marker, covered)} by the queue that takes the least cost, then the first pixel, then the least label."""
    cost, label, queue = {}, {}, []
    for (y, x), (v, m, covered) in pixels.items():
        if m:
            cost[y, x], label[y, x] = v, m
            queue.append((v, y, x, m))
    heapq.heapify(queue)
    while queue:
        c, y, x, m = heapq.heappop(queue)
        if (cost[y, x], label[y, x]) != (c, m):
            continue
        for n in [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]:
            if n in pixels and pixels[n][2] and not pixels[n][1]:
                new = max(c, pixels[n][0])
                if n not in cost or new < cost[n] or (new == cost[n] and m < label[n]):
                    cost[n], label[n] = new, m
                    heapq.heappush(queue, (new, *n, m))
    return {at: label.get(at, 0) for at in pixels}


def raster(seed, height, width, levels, markers):
    rng = random.Random(seed)
    out = {(y, x): (rng.randrange(levels), 0, rng.random() < 0.9) for y in range(height) for x in range(width) if rng.random() < 0.98}
    for at in rng.sample(sorted(a for a, p in out.items() if p[2]), markers):
        out[at] = (out[at][0], rng.randrange(1, 5), True)
    return out


def frame(spark, rasters):
    rows = [(i, y, x, *p) for i, pixels in rasters.items() for (y, x), p in pixels.items()]
    return spark.createDataFrame(rows, "raster_id bigint, y bigint, x bigint, v bigint, marker bigint, covered boolean")


@pytest.mark.parametrize("side", [8, 16, 64])
def test_tiles_flood_like_one_raster(spark, side):
    """Few levels give plateaus and ties; a winding way crosses many tiles; a raster may lack markers, or be one pixel."""
    snake = {(y, x): (1 if y % 2 == 0 or x == (0 if y % 4 == 3 else 19) else 9, 0, True) for y in range(13) for x in range(20)}
    snake[0, 0], snake[12, 19] = (1, 3, True), (5, 2, True)
    rasters = {1: raster(1, 30, 37, 3, 6), 2: raster(2, 20, 9, 40, 3), 3: {(5, 7): (1, 0, True)}, 4: {at: (v, 0, c) for at, (v, _, c) in raster(4, 6, 6, 3, 1).items()}, 5: snake}
    got = {}
    for r in w.watershed(frame(spark, rasters), side).collect():
        got.setdefault(r["raster_id"], {})[r["y"], r["x"]] = r["label"]
    assert got == {i: flooded(p) for i, p in rasters.items()}


def test_no_rows(spark):
    assert w.watershed(frame(spark, {}).where("false")).count() == 0


def test_rules(spark):
    rasters = {1: {(0, 0): (1, 2, False), (0, 1): (1, 3, True)}, 2: {(0, 0): (1, 0, True), (4, 4): (1, 0, True)}, 3: {(0, 0): (1, 1, True)}}
    got = {tuple(r) for r in w.watershed_rules(frame(spark, rasters)).collect()}
    assert got == {("1:0:0", "marker"), ("2", "markers")}
