"""Scene generators: one object gives many primitives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.durable import fanned_out
from loamgrid.functions.intmath import div, floor_div
from loamgrid.operators.checks import digest, violations
from loamgrid.operators.geometry import PLANES, centre, convex, edges

#: The least rise of a hip roof in mm, the jitter's share of the trees' spacing, and the rotations of its hash.
RISE, JITTER, ROTATIONS = 1_500, 5, (17, 29)


def hip_roofs(objects: DataFrame, most_rise: int) -> DataFrame:
    """A plane for each edge of the roof of convex rings of up to PLANES edges (id, ring, height, start): id, i, face and the
    apex x, y, z.

    The apex is the mean of the corners, a third of the height above the walls, at least RISE and at most most_rise. Faces
    take turns between 0 and 1, beginning with start.
    """
    n = F.size("ring") - 1
    rise = F.least(F.greatest(div(F.col("height"), 3), F.lit(RISE)), F.lit(most_rise))
    roofs = objects.where((n <= PLANES) & convex(F.col("ring"))).withColumn("_c", centre(F.col("ring")))
    each = roofs.select("id", "start", F.col("_c.x").alias("x"), F.col("_c.y").alias("y"), (F.col("height") + rise).alias("z"), F.explode(edges(F.col("ring"))).alias("_e"))
    return each.select("id", F.col("_e.i").cast("bigint").alias("i"), F.pmod(F.col("_e.i") + F.col("start"), F.lit(2)).cast("bigint").alias("face"), "x", "y", "z")


def mixed(x: np.ndarray) -> np.ndarray:
    """intmath.mix64 on arrays of unsigned 64-bit numbers."""
    for by, multiplier in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(by))) * np.uint64(multiplier)
    return x ^ (x >> np.uint64(31))


def turned_left(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def inside(rings: list[list[dict]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """geometry.even_odd on arrays of points: in the first ring and in no other."""
    origin = int(x.min(initial=0)), int(y.min(initial=0))
    out = None
    for ring in rings:
        px, py = (np.array([int(p[c]) - o for p in ring], dtype=object) for c, o in zip("xy", origin, strict=True))
        small = max(abs(v) for v in (*px, *py, int(x.max(initial=0)) - origin[0], int(y.max(initial=0)) - origin[1], 0)) < 2**30
        kind = np.int64 if small else object
        px, py, qx, qy = px.astype(kind), py.astype(kind), (x - origin[0]).astype(kind), (y - origin[1]).astype(kind)
        odd = np.zeros(len(x), bool)
        for i in range(len(ring) - 1):
            across = (py[i] > qy) != (py[i + 1] > qy)
            side = (px[i + 1] - px[i]) * (qy - py[i]) - (qx - px[i]) * (py[i + 1] - py[i])
            odd ^= across & ((side > 0) if py[i + 1] > py[i] else (side < 0))
        out = odd if out is None else out & ~odd
    return np.zeros(len(x), bool) if out is None else out


#: Points of a grid that are made and tested at once.
GRID = 1 << 16


def tree_centres(shapes: DataFrame, spacing: int, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """The columns of keep (id among them), n, x and y of trees inside polygons (id, rings; the first ring without the others): points of
    a world grid, each moved by a hash of the id and the point. n numbers the grid's points of a shape, in order.

    Shapes are cut into runs of the grid's columns of GRID points at most, so that a large wood is spread over tasks; a
    run's points are moved and tested as arrays. Null and empty shapes have no trees.
    """
    outer = F.col("rings")[0]
    first = lambda c: floor_div(F.array_min(F.transform(outer, lambda p: p[c])), spacing)
    last = lambda c: floor_div(F.array_max(F.transform(outer, lambda p: p[c])), spacing)
    boxed = shapes.where(F.size("rings") > 0).withColumns({"_x0": first("x"), "_x1": last("x"), "_y0": first("y"), "_y1": last("y")})
    step = F.greatest(F.lit(1), div(F.lit(GRID), F.col("_y1") - F.col("_y0") + 1))
    runs = boxed.select(*keep, "rings", "_x0", "_y0", "_y1", F.explode(F.sequence("_x0", "_x1", step)).alias("_from"), F.least(step - 1, F.col("_x1") - F.col("_x0")).alias("_more"), "_x1")
    span = spacing // JITTER

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = {c: batch.column(c).to_pylist() for c in ("id", "_x0", "_x1", "_y0", "_y1", "_from", "_more")}
            found = []
            for i, rings in enumerate(batch.column("rings").to_pylist()):
                r = {c: v[i] for c, v in numbers.items()}
                columns = np.arange(r["_from"], min(r["_from"] + r["_more"], r["_x1"]) + 1)
                rows = np.arange(r["_y0"], r["_y1"] + 1)
                gx, gy = np.repeat(columns, len(rows)) * spacing, np.tile(rows, len(columns)) * spacing
                seed = mixed(np.array([r["id"]], np.int64).view(np.uint64) ^ turned_left(gx.view(np.uint64), ROTATIONS[0]) ^ gy.view(np.uint64))
                moved = [at + (s % np.uint64(2 * span + 1)).astype(np.int64) - span for at, s in ((gx, seed), (gy, turned_left(seed, ROTATIONS[1])))]
                ok = inside(rings, *moved)
                n = (np.repeat(columns - r["_x0"], len(rows)) * len(rows) + np.tile(np.arange(len(rows)), len(columns)))[ok]
                found.append((np.full(len(n), i), n, moved[0][ok], moved[1][ok]))
            at, n, x, y = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at)) for c in keep] + [pa.array(v, pa.int64()) for v in (n, x, y)], [*keep, "n", "x", "y"])

    kinds = ", ".join(f"`{c}` {runs.schema[c].dataType.simpleString()}" for c in keep)
    return fanned_out(runs, "id", "_from").mapInArrow(plant, f"{kinds}, n bigint, x bigint, y bigint")


def patches(records: DataFrame, allowed: list[str]) -> DataFrame:
    """The broken rules of benchmark patches: bounds in degrees, identity, classes, digest and licence."""
    west, south, east, north = (F.col(c) for c in ("west", "south", "east", "north"))
    filled = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    return violations(records, F.col("id"), {
        "longitude": (west >= -180) & (west < east) & (east <= 180), "latitude": (south >= -90) & (south < north) & (north <= 90), "identity": filled("patch_id") & (F.size("source_record_ids") > 0),
        "classes": F.size(F.array_except("classes", F.array(*[F.lit(a) for a in allowed]))) == 0, "digest": digest(F.col("sha256")), "license": filled("license"),
    })


def codes(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """rows with column, a name, as its number in names and back again; what is not a name is null both ways."""
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column)) - 1
    coded = rows.withColumn("code", F.when(number >= 0, number.cast("bigint")))
    return coded.withColumn("decoded", F.get(F.array(*[F.lit(n) for n in names]), F.col("code").cast("int")))


