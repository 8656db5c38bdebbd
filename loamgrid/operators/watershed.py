"""Marker watersheds of rasters of any size, tile by tile.

A tile is flooded on its own, from its markers and from what its neighbours say about the pixels along its border.
Borders alone are shuffled and written, round by round; only tiles beside a border that has changed are flooded again.
Costs settle first, then labels, along the ways over which costs were reached. Both only ever fall, so the rounds end
with the same result as one flood of the whole raster, after as many rounds as the longest way crosses tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions.durable import removed, written
from loamgrid.operators.checks import violations

#: Pixels of a tile's side.
SIDE = 256
NONE = np.iinfo(np.int64).max
KEYS = ["raster_id", "ty", "tx"]
STRIPS = ["top", "bottom", "left", "right"]
TILES = "raster_id bigint, ty bigint, tx bigint, v binary, marker binary, covered binary, given binary"
BORDERS = "raster_id bigint, ty bigint, tx bigint, top binary, bottom binary, left binary, right binary"


def around(wide: np.ndarray) -> list[np.ndarray]:
    """The eight neighbours of the pixels inside a border of one."""
    h, w = wide.shape
    return [wide[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def settled_costs(v: np.ndarray, marker: np.ndarray, free: np.ndarray, halo: np.ndarray) -> np.ndarray:
    """The least highest v on a way to each pixel, in halo's middle; halo holds the neighbours' costs around it."""
    cost = halo.copy()
    cost[1:-1, 1:-1] = np.where(marker > 0, v, NONE)
    while True:
        lowest = np.minimum.reduce(around(cost))
        inner = cost[1:-1, 1:-1]
        new = np.where(free & (lowest < NONE), np.minimum(inner, np.maximum(lowest, v)), inner)
        if np.array_equal(new, inner):
            return cost
        cost[1:-1, 1:-1] = new


def settled_labels(v: np.ndarray, marker: np.ndarray, free: np.ndarray, cost: np.ndarray, halo: np.ndarray) -> np.ndarray:
    """The least label that reaches each pixel at its cost."""
    label = halo.copy()
    label[1:-1, 1:-1] = np.where(marker > 0, marker, NONE)
    ways = [(c < NONE) & (np.maximum(c, v) == cost[1:-1, 1:-1]) for c in around(cost)]
    while True:
        told = np.minimum.reduce([np.where(ok, near, NONE) for ok, near in zip(ways, around(label), strict=True)])
        inner = label[1:-1, 1:-1]
        new = np.where(free, np.minimum(inner, told), inner)
        if np.array_equal(new, inner):
            return label
        label[1:-1, 1:-1] = new


def halo_of(heard: list[dict] | None, side: int) -> np.ndarray:
    """A grid with a border of one that holds the strips heard from the eight neighbours."""
    out = np.full((side + 2, side + 2), NONE)
    at = lambda d: {-1: 0, 0: slice(1, -1), 1: side + 1}[d]
    for h in heard or []:
        strip = np.frombuffer(h["strip"], np.int64)
        out[at(h["dy"]), at(h["dx"])] = strip if h["dy"] == 0 or h["dx"] == 0 else strip[0]
    return out


def opened(row: dict, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """v, markers and the free pixels of a tile."""
    v, marker = (np.frombuffer(row[c], np.int64).reshape(side, side) for c in ("v", "marker"))
    return v, marker, (np.frombuffer(row["covered"], np.uint8).reshape(side, side) > 0) & (marker == 0)


def messages(borders: DataFrame, side: int) -> DataFrame:
    """What each tile hears: a row for each strip, addressed to the neighbour, with dy and dx from there to the sender."""
    first, last = (lambda c: F.substring(c, 1, 8)), (lambda c: F.substring(c, side * 8 - 7, 8))
    sent = [(1, 0, F.col("bottom")), (-1, 0, F.col("top")), (0, 1, F.col("right")), (0, -1, F.col("left")), (1, 1, last("bottom")), (1, -1, first("bottom")), (-1, 1, last("top")), (-1, -1, first("top"))]
    each = F.explode(F.array(*[F.struct(F.lit(dy).alias("y"), F.lit(dx).alias("x"), strip.alias("strip")) for dy, dx, strip in sent]))
    out = borders.withColumn("_m", each)
    return out.select("raster_id", (F.col("ty") + F.col("_m.y")).alias("ty"), (F.col("tx") + F.col("_m.x")).alias("tx"), (-F.col("_m.y")).alias("dy"), (-F.col("_m.x")).alias("dx"), "_m.strip", "changed")


def heard(borders: DataFrame, side: int, name: str) -> DataFrame:
    """The strips of all neighbours of each tile, eight at most, and whether one of them has changed."""
    return messages(borders, side).groupBy(*KEYS).agg(F.collect_list(F.struct("dy", "dx", "strip")).alias(name), F.bool_or("changed").alias("changed"))


def strips(rows: list[dict], grids: list[np.ndarray]) -> pa.RecordBatch:
    inner = [g[1:-1, 1:-1] for g in grids]
    cut = {"top": lambda g: g[0], "bottom": lambda g: g[-1], "left": lambda g: g[:, 0], "right": lambda g: g[:, -1]}
    return pa.RecordBatch.from_pydict({**{k: pa.array([r[k] for r in rows], pa.int64()) for k in KEYS}, **{s: pa.array([np.ascontiguousarray(f(g)).tobytes() for g in inner], pa.binary()) for s, f in cut.items()}})


def rounds(tiles: DataFrame, side: int, flood, start: DataFrame) -> DataFrame:
    """Borders of all tiles once no round changes one. flood: from tiles with heard to their borders."""
    now = written(start.withColumn("changed", F.lit(True)), "borders")
    while True:
        told = heard(now, side, "heard").where("changed").drop("changed")
        again = tiles.join(told, KEYS)
        was = now.select(*KEYS, F.struct(*STRIPS).alias("_was"))
        new = flood(again).join(was, KEYS).select(*KEYS, *STRIPS, (F.struct(*STRIPS) != F.col("_was")).alias("changed"))
        rest = now.join(told.select(*KEYS), KEYS, "left_anti").select(*KEYS, *STRIPS, F.lit(False).alias("changed"))
        after = written(new.unionByName(rest), "borders")
        removed(now)
        now = after
        if not now.where("changed").limit(1).count():
            return now.drop("changed")


def watershed(raster: DataFrame, side: int = SIDE) -> DataFrame:
    """label of every pixel: its marker's, else that of the marker it is reached from at the least highest v; 0 if from none.

    raster: raster_id, y, x, v, marker (0: none) and covered. Ways go over corners, over covered pixels, and never through
    another marker's pixel. The lower label wins among equal costs. Rasters may have any size and shape. No rows give no
    rows; what watershed_rules() says of a raster does not stop it: markers outside coverage are left out as ways only.
    """

    def pack(rows: pa.Table) -> pa.Table:
        y, x = (rows.column(c).to_numpy() for c in "yx")
        ty, tx = int(y[0] // side), int(x[0] // side)
        at = y - ty * side, x - tx * side
        grids = {"v": np.zeros((side, side), np.int64), "marker": np.zeros((side, side), np.int64), "covered": np.zeros((side, side), np.uint8), "given": np.zeros((side, side), np.uint8)}
        for c in ("v", "marker", "covered"):
            grids[c][at] = rows.column(c).to_numpy()
        grids["given"][at] = 1
        return pa.table({"raster_id": [rows.column("raster_id")[0].as_py()], "ty": [ty], "tx": [tx], **{c: pa.array([g.tobytes()], pa.binary()) for c, g in grids.items()}})

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in map(lambda i: batch.slice(i, 1).to_pylist()[0], range(batch.num_rows)):
                yield strips([row], [settled_costs(*opened(row, side), halo_of(row.get("heard"), side))])

    def both(row: dict) -> tuple[np.ndarray, np.ndarray]:
        tile = opened(row, side)
        cost = settled_costs(*tile, halo_of(row.get("costs"), side))
        return cost, settled_labels(*tile, cost, halo_of(row.get("heard"), side))

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in map(lambda i: batch.slice(i, 1).to_pylist()[0], range(batch.num_rows)):
                yield strips([row], [both(row)[1]])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in map(lambda i: batch.slice(i, 1).to_pylist()[0], range(batch.num_rows)):
                label = both(row)[1][1:-1, 1:-1]
                y, x = np.nonzero(np.frombuffer(row["given"], np.uint8).reshape(side, side))
                found = label[y, x]
                yield pa.RecordBatch.from_pydict({"raster_id": np.full(len(y), row["raster_id"]), "y": y + row["ty"] * side, "x": x + row["tx"] * side, "label": np.where(found == NONE, 0, found)})

    long = lambda c: F.col(c).cast("bigint").alias(c)
    rows = raster.select(*map(long, ("raster_id", "y", "x", "v", "marker")), "covered")
    floor = lambda c: F.floor(F.col(c) / side).alias(f"t{c}")
    tiles = written(rows.groupBy("raster_id", floor("y"), floor("x")).applyInArrow(pack, TILES), "tiles")
    final = "raster_id bigint, y bigint, x bigint, label bigint"
    several = tiles.groupBy("raster_id").count().where("count > 1").select("raster_id")
    if not several.limit(1).count():
        return tiles.mapInArrow(unpack, final)  # nothing lies beyond a border
    settled = rounds(tiles, side, lambda t: t.mapInArrow(costs, BORDERS), tiles.mapInArrow(costs, BORDERS))
    known = heard(settled.withColumn("changed", F.lit(False)), side, "costs").drop("changed")
    costed = written(tiles.join(known, KEYS, "left"), "costed")
    named = rounds(costed, side, lambda t: t.mapInArrow(labels, BORDERS), costed.mapInArrow(labels, BORDERS))
    told = heard(named.withColumn("changed", F.lit(False)), side, "heard").drop("changed")
    return costed.join(told, KEYS, "left").mapInArrow(unpack, final)


def watershed_rules(raster: DataFrame) -> DataFrame:
    """The broken rules of rasters for watershed(): a marker outside coverage ('marker', by pixel), a raster without one ('markers')."""
    place = F.concat_ws(":", *[F.col(c).cast("string") for c in ("raster_id", "y", "x")])
    first = F.row_number().over(Window.partitionBy("raster_id").orderBy("y", "x")) == 1
    counted = raster.withColumn("_n", F.count_if(F.col("marker") > 0).over(Window.partitionBy("raster_id"))).withColumn("_first", first)
    pixel = violations(counted, place, {"marker": (F.col("marker") == 0) | F.col("covered")})
    return pixel.unionByName(violations(counted.where("_first"), F.col("raster_id").cast("string"), {"markers": F.col("_n") > 0}))
