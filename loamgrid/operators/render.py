"""From world objects to the tiles of one picture.

Objects (id, class, height, parts) become triangles in arrays of single rows, without a shuffle but one by object for
the numbers of their triangles. Triangles are dealt to the tiles that they may touch, guard band included, and only
they are shuffled: each task draws the triangles of its tiles, streamed in order, into a depth buffer of one tile. A
tile with very many triangles is drawn in several pieces, whose buffers are merged: the greatest depth, of equals the
lowest key, does not depend on the order. Shadows, patterns and outlines follow within the tile; the guard band holds
what outlines look at, so tiles fit without seams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions.durable import fanned_out, written
from loamgrid.functions.intmath import div, floor_div, let, variation
from loamgrid.operators.facades import Facade, facades
from loamgrid.operators.geometry import PLANES, centre, convex
from loamgrid.operators.manifests import projected_box, scene_vertex
from loamgrid.operators.scene import RISE, tree_centres

#: Subpixels of a pixel and where in it it is sampled; pixels round the picture; numbers of the passes;
#: depth layers of classes, their ground colours in the style, and the directions of a crown's corners in thousandths.
SUBPIXELS, SAMPLE, MARGIN = 256, 128, 32
GROUND, WALL, ROOF, CROWN, SHADOW, DETAIL = 1, 2, 3, 4, 5, 8
LAYERS = {"unknown": 0, "terrain": 1, "water": 2, "vegetation": 3, "parking": 4, "athletic-surface": 4, "road": 5, "path": 6, "building": 7}
CORNERS = ((1000, 0), (707, 707), (0, 1000), (-707, 707), (-1000, 0), (-707, -707), (0, -1000), (707, -707), (1000, 0))
#: What crowns add to the trees' radius at most, in the guard and by variation, and the multipliers of keys.
CROWN_SPREAD, CROWN_STEP = 1_000, 500
KEY_STAGE, KEY_ORDINAL, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Triangles of a tile that one task draws in one piece, and pixels that are worked out at once.
PIECE, CHUNK = 200_000, 1 << 20


@dataclass(frozen=True)
class Style:
    """Measures in mm and palette indexes. step: mm of the world along a screen axis for a pixel; rise: mm of height for one."""

    step: int
    rise: int
    terrain: tuple[int, int] = (1, 2)
    canopy: tuple[int, ...] = (3, 16, 17)
    water: int = 4
    building: tuple[int, int, int] = (5, 6, 7)
    path: int = 8
    road: int = 9
    parking: tuple[int, int] = (10, 11)
    athletic: tuple[int, int] = (12, 13)
    roof_faces: tuple[int, int] = (18, 19)
    shadow: int = 14
    outline: int = 15
    shadow_x: int = 3_000
    shadow_y: int = -2_000
    roof_rise: int = 4_000
    hip_roofs: bool = True
    tree_spacing: int = 4_000
    tree_radius: int = 1_500
    tree_height: int = 6_000
    terrain_dither: int = 7
    athletic_dither: int = 5
    parking_lines: int = 4
    facade: Facade | None = None

    def colours(self) -> dict[str, int]:
        return {"unknown": 0, "terrain": self.terrain[0], "water": self.water, "vegetation": self.canopy[0], "parking": self.parking[0], "athletic-surface": self.athletic[0], "road": self.road, "path": self.path, "building": self.building[1]}

    def eligible(self) -> list[int]:
        """Colours on which a shadow shows."""
        return sorted({*self.terrain, *self.athletic, *self.parking, self.road, self.path, self.water, self.shadow})

    def families(self) -> np.ndarray:
        """By palette index: 1 for buildings, 2 for crowns, else 0."""
        out = np.zeros(256, np.int8)
        out[list(self.canopy)] = 2
        out[[*self.building, *(self.roof_faces if self.hip_roofs else ())]] = 1
        if self.facade:
            out[[*self.facade.windows, self.facade.door_colour, self.facade.accent]] = 1
        return out


def projected(x: int, y: int, z: int, style: Style) -> tuple[int, int]:
    """A single point in subpixels."""
    cut = lambda a, b: a // b if a >= 0 else -(-a // b)
    return cut((x - y) * SUBPIXELS, style.step), cut(cut((x + y) * SUBPIXELS, style.step), 2) - cut(z * SUBPIXELS, style.rise)


def required_guard(style: Style) -> int:
    """Pixels by which what an object draws may leave its box: shadow, crown and outline."""
    r, h = style.tree_radius + CROWN_SPREAD, style.tree_height
    points = [(style.shadow_x, style.shadow_y, 0), (r, -r, 0), (-r, r, 0), (r, r, h), (-r, -r, h)]
    return -(-max(abs(v) for p in points for v in projected(*p, style)) // SUBPIXELS) + 2


def render_bounds(objects: DataFrame, style: Style) -> DataFrame:
    """id, min_x, min_y, max_x and max_y, in subpixels, of all that an object may draw."""
    every = F.flatten(F.flatten("parts"))
    low, high = (lambda c: F.array_min(F.transform(every, lambda p: p[c]))), (lambda c: F.array_max(F.transform(every, lambda p: p[c])))
    box = objects.select("id", "class", *[low(c).alias(f"a{c}") for c in "xyz"], *[(high(c) + (F.col("height") if c == "z" else 0)).alias(f"b{c}") for c in "xyz"])
    tree, house = F.col("class") == "vegetation", F.col("class") == "building"
    r = F.when(tree, style.tree_radius + CROWN_SPREAD).otherwise(0)
    top = F.when(tree, F.greatest("bz", F.col("az") + style.tree_height)).when(house & F.lit(style.hip_roofs), F.col("bz") + style.roof_rise).otherwise(F.col("bz"))
    box = box.select("id", "class", "az", *[(F.col(f"a{c}") - r).alias(f"a{c}") for c in "xy"], *[(F.col(f"b{c}") + r).alias(f"b{c}") for c in "xy"], top.alias("bz"))
    moved = lambda c, by: F.when(tree | house, F.col(c) + by).otherwise(F.col(c))
    lows = [F.least(f"a{c}", moved(f"a{c}", by)) for c, by in (("x", style.shadow_x), ("y", style.shadow_y))]
    highs = [F.greatest(f"b{c}", moved(f"b{c}", by)) for c, by in (("x", style.shadow_x), ("y", style.shadow_y))]
    return box.select("id", projected_box(*lows, F.col("az"), *highs, F.col("bz"), SUBPIXELS, style.step, style.rise).alias("_b")).select("id", "_b.*")


def layout(objects: DataFrame, style: Style) -> tuple[int, int, int, int] | None:
    """(offset x, offset y in subpixels, width, height in pixels) of the picture of all objects; None without any."""
    m = MARGIN * SUBPIXELS
    b = render_bounds(objects, style).agg(F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y")).first()
    if b[0] is None:
        return None
    span = lambda low, high: -(-(high - low + 2 * m) // SUBPIXELS)
    return m - b[0], m - b[1], span(b[0], b[2]), span(b[1], b[3])


def to_layout(x: Column, y: Column, z: Column, style: Style, offset: tuple[int, int]) -> Column:
    """struct(x, y): the pixel of the layout that a point of the world falls in."""
    v = scene_vertex(x, y, z, F.lit(0), SUBPIXELS, style.step, style.rise)
    return let(v, lambda p: F.struct(floor_div(p["x"] + offset[0], SUBPIXELS).alias("x"), floor_div(p["y"] + offset[1], SUBPIXELS).alias("y")))


def named(value: str, name: str, body: str) -> str:
    """SQL: body with name standing for value, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def vertex(x: str, y: str, z: str, layer: str | int, style: Style, offset: tuple[int, int]) -> str:
    """SQL: the vertex (x, y, depth) of the layout for a point of the world."""
    flat = lambda v: f"({v}) * {SUBPIXELS}L div {style.step}"
    return f"named_struct('x', {flat(f'({x}) - ({y})')} + {offset[0]}L, 'y', {flat(f'({x}) + ({y})')} div 2 - ({z}) * {SUBPIXELS}L div {style.rise} + {offset[1]}L, 'depth', (({x}) + ({y}) + ({z})) * 16L + {layer})"


def face(a: str, b: str, c: str, v: str | int) -> str:
    return f"named_struct('a', {a}, 'b', {b}, 'c', {c}, 'v', CAST({v} AS BIGINT))"


def ring_edges(ring: str) -> str:
    """SQL: a ring's edges as structs of both ends."""
    return f"transform(slice({ring}, 1, greatest(size({ring}) - 1, 0)), (_p, _j) -> named_struct('a', _p, 'b', {ring}[_j + 1]))"


def chosen(options: tuple[int, ...], i: str) -> str:
    return f"array({', '.join(map(str, options))})[CAST(({i}) % {len(options)} AS INT)]"


def solid(faces: str) -> str:
    """SQL: the faces that are no mere lines."""
    return f"filter({faces}, f -> (f.b.x - f.a.x) * (f.c.y - f.a.y) - (f.b.y - f.a.y) * (f.c.x - f.a.x) <> 0)"


def filled(rings: str, v: str | int) -> str:
    """SQL: the faces that fill rings of vertices (x, y, depth) by the even-odd rule, holes and all.

    The heights of all vertices cut the plane into strips in which edges do not end. The edges that cross a strip,
    from left to right, bound trapezoids by twos; each gives two faces. Crossings are interpolated along the edge's own
    direction and truncated. Strips that an odd number of edges cross (rings that are not closed) give none.
    """
    heights = f"array_sort(array_distinct(flatten(transform({rings}, r -> transform(r, p -> p.y)))))"
    every = f"transform(flatten(transform({rings}, r -> {ring_edges('r')})), (e, i) -> named_struct('a', e.a, 'b', e.b, 'i', i))"
    at = lambda y, c: f"e.a.{c} + (e.b.{c} - e.a.{c}) * ({y} - e.a.y) div (e.b.y - e.a.y)"
    end = lambda y: f"named_struct('x', {at(y, 'x')}, 'y', {y}, 'depth', {at(y, 'depth')})"
    cut = named(f"named_struct('low', {end('low')}, 'high', {end('s.h[j + 1]')})", "q", "named_struct('sum', q.low.x + q.high.x, 'i', e.i, 'low', q.low, 'high', q.high)")
    across = f"transform(filter(s.e, e -> least(e.a.y, e.b.y) <= low AND greatest(e.a.y, e.b.y) >= s.h[j + 1]), e -> {cut})"
    l, r = "o[2 * k]", "o[2 * k + 1]"
    pairs = f"flatten(transform(filter(sequence(0, size(o)), k -> size(o) % 2 = 0 AND 2 * k + 1 < size(o)), k -> array({face(f'{l}.low', f'{r}.low', f'{r}.high', v)}, {face(f'{l}.low', f'{r}.high', f'{l}.high', v)})))"
    strips = f"flatten(transform(slice(s.h, 1, greatest(size(s.h) - 1, 0)), (low, j) -> {named(f'array_sort({across})', 'o', pairs)}))"
    return named(f"named_struct('h', {heights}, 'e', filter({every}, e -> e.a.y <> e.b.y))", "s", strips)


def truncated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b towards zero."""
    q = a // b
    return q + ((q < 0) & (q * b != a))


def fills(rings: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The solid() faces of filled() for a batch of rings: the row of each, and (x, y, depth) of its corners, in the same order."""
    rows, of_ring = len(rings), rings.flatten()
    ring = np.repeat(np.arange(len(of_ring)), np.asarray(of_ring.value_lengths()))
    row = np.repeat(np.arange(rows), np.asarray(rings.value_lengths()))[ring]
    points = of_ring.flatten()
    p = np.column_stack([np.asarray(points.field(c)) for c in ("x", "y", "depth")])
    # All heights of all rows in order, and where each point's stands among them; strip j goes from j to the next.
    order = np.lexsort((p[:, 1], row))
    new = np.r_[True, (np.diff(row[order]) != 0) | (np.diff(p[order, 1]) != 0)][: len(p)]
    heights, at = p[order, 1][new], np.empty(len(p), np.int64)
    at[order] = np.cumsum(new) - 1
    start = np.flatnonzero((ring[1:] == ring[:-1]) & (p[1:, 1] != p[:-1, 1]))
    reach = np.abs(p[start + 1] - p[start]).max(axis=0, initial=0)
    if int(reach[1]) * max(int(reach[0]), int(reach[2])) >= 2**63:
        raise OverflowError("an edge too long for BIGINT")
    first = np.minimum(at[start], at[start + 1])
    n = np.abs(at[start + 1] - at[start])
    edge = np.repeat(start, n)
    strip = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def cross(y: np.ndarray) -> np.ndarray:
        a, b = p[edge], p[edge + 1]
        x, depth = (a[:, c] + truncated((b[:, c] - a[:, c]) * (y - a[:, 1]), b[:, 1] - a[:, 1]) for c in (0, 2))
        return np.column_stack([x, y, depth])

    low, high = cross(heights[strip]), cross(heights[np.minimum(strip + 1, len(heights) - 1)])
    order = np.lexsort((edge, low[:, 0] + high[:, 0], strip))
    edge, strip, low, high = edge[order], strip[order], low[order], high[order]
    _, begin, size = np.unique(strip, return_index=True, return_counts=True)
    nth = np.arange(len(strip)) - np.repeat(begin, size)
    l = np.flatnonzero((nth % 2 == 0) & (np.repeat(size, size) % 2 == 0))
    faces = np.stack([np.stack([low[l], low[l + 1], high[l + 1]], axis=1), np.stack([low[l], high[l + 1], high[l]], axis=1)], axis=1).reshape(-1, 3, 3)
    u, w = faces[:, 1] - faces[:, 0], faces[:, 2] - faces[:, 0]
    flat = u[:, 0] * w[:, 1] == u[:, 1] * w[:, 0]
    return np.repeat(row[edge[l]], 2)[~flat], faces[~flat]


FACES = "faces array<struct<" + ", ".join(f"{p}: struct<x: bigint, y: bigint, depth: bigint>" for p in "abc") + ", v: bigint>>"


def filled_rows(rows: DataFrame, order: int, seq: str, stage: int, rings: str, v: str | int) -> DataFrame:
    """id, part, _order, _seq, stage and faces of filled(), worked out for batches of rows at once. Rings with nulls give none."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, faces = fills(batch.column("rings"))
            some, first = np.unique(of, return_index=True)
            corners = [pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(faces[:, i, c])) for c in range(3)], ["x", "y", "depth"]) for i in range(3)]
            every = pa.StructArray.from_arrays([*corners, batch.column("v").take(pa.array(of))], [*"abc", "v"])
            held = pa.ListArray.from_arrays(pa.array(np.r_[first, len(of)].astype(np.int32)), every)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(some)) for c in ("id", "part", "_seq")], held], ["id", "part", "_seq", "faces"])

    made = rows.select("id", "part", F.expr(f"{seq} AS _seq"), F.expr(f"explode(array({rings})) AS rings"), F.expr(f"CAST({v} AS BIGINT) AS v"))
    known = made.where("NOT exists(flatten(rings), p -> p.x IS NULL OR p.y IS NULL OR p.depth IS NULL)")
    out = known.mapInArrow(fill, f"id {rows.schema['id'].dataType.simpleString()}, part int, _seq bigint, {FACES}")
    return out.select("id", "part", F.lit(order).alias("_order"), "_seq", F.lit(stage).alias("stage"), "faces")


def crown(style: Style, offset: tuple[int, int]) -> tuple[str, str]:
    """SQL: (faces of the crown, ring of its shadow) of a tree at x, y, of a row with height and the variations _v3 and _v4."""
    directions = "array(" + ", ".join(f"named_struct('x', {x}L, 'y', {y}L)" for x, y in CORNERS) + ")"
    corners = lambda radius, lift, layer, dx=0, dy=0: f"transform({directions}, d -> {vertex(f'x + {dx} + d.x * {radius} div 1000', f'y + {dy} + d.y * {radius} div 1000', lift, layer, style, offset)})"
    rings = named(f"named_struct('r', {style.tree_radius}L + _v3 * {CROWN_STEP}L, 'h', greatest(height, {style.tree_height}L))", "t", f"named_struct('low', {corners('t.r', 't.h div 3', LAYERS['vegetation'])}, 'high', {corners('(t.r * 2 div 3)', 't.h * 5 div 6', LAYERS['vegetation'])}, 'top', {vertex('x', 'y', 't.h', LAYERS['vegetation'], style, offset)})")
    colour = chosen(style.canopy, "i + _v4")
    eighth = f"array({face('c.low[i]', 'c.low[i + 1]', 'c.high[i + 1]', colour)}, {face('c.low[i]', 'c.high[i + 1]', 'c.high[i]', colour)}, {face('c.high[i]', 'c.high[i + 1]', 'c.top', chosen(style.canopy, 'i'))})"
    return named(rings, "c", f"flatten(transform(sequence(0, 7), i -> {eighth}))"), f"array({corners(f'{style.tree_radius}L', '0L', LAYERS['terrain'], style.shadow_x, style.shadow_y)})"


def triangles(objects: DataFrame, style: Style, offset: tuple[int, int]) -> DataFrame:
    """All triangles of objects (id, class, height, parts: polygons of rings of points x, y, z; the first ring is the outer one).

    Returns id, stage, ordinal, a, b, c (x, y, depth) and v. Ordinals count an object's triangles in the order in which they
    are made (shadows on their own): by part its ground, its trees by their grid, its walls, its roof. Triangles without area
    take none. Classes without a layer, null heights and null or empty parts give nothing of what needs them.
    """
    layers, colours = (F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) for d in (LAYERS, style.colours()))
    known = objects.where(F.col("class").isin(list(LAYERS))).select("id", "class", F.coalesce("height", F.lit(0)).cast("bigint").alias("height"), F.posexplode("parts").alias("part", "rings")).where(F.size("rings") > 0)
    known = fanned_out(known, "id", "part")
    varied = {f"_v{n}": variation(F.col("id"), n) for n in (2, 3, 4)}
    known = known.withColumns({"_layer": F.element_at(layers, F.col("class")).cast("bigint"), "_colour": F.element_at(colours, F.col("class")), **varied})
    placed = lambda lift, layer, dx=0, dy=0: f"transform(rings, r -> transform(r, p -> {vertex(f'p.x + {dx}', f'p.y + {dy}', f'p.z + {lift}', layer, style, offset)}))"
    # Out of an array the faces are finished: tests of their number do not make them again, nor before rows are dealt out.
    made = lambda rows, order, seq, stage, faces: rows.select("id", "part", F.lit(order).alias("_order"), F.expr(f"{seq} AS _seq"), F.lit(stage).alias("stage"), F.expr(f"explode(array({solid(faces)})) AS faces"))
    ring = F.col("rings")[0]
    n = (F.size(ring) - 1).cast("bigint")
    mean_z = div(F.aggregate(F.slice(ring, 1, F.size(ring) - 1), F.lit(0).cast("bigint"), lambda s, p: s + p["z"]), n)
    hipped = F.lit(style.hip_roofs) & (F.size("rings") == 1) & (n <= PLANES) & convex(ring)
    house = known.where("class = 'building' and height > 0").withColumns({"_hip": hipped, "_c": centre(ring), "_z": mean_z})
    top = LAYERS["building"]
    corner = lambda p, lift: vertex(f"{p}.x", f"{p}.y", f"{p}.z + {lift}", top, style, offset)
    light = f"CASE WHEN e.b.x - e.a.x >= e.b.y - e.a.y THEN {style.building[1]} ELSE {style.building[2]} END"
    ends = f"named_struct('a0', {corner('e.a', 0)}, 'b0', {corner('e.b', 0)}, 'a1', {corner('e.a', 'height')}, 'b1', {corner('e.b', 'height')}, 'v', {light})"
    wall = named(ends, "q", f"array({face('q.a0', 'q.b0', 'q.b1', 'q.v')}, {face('q.a0', 'q.b1', 'q.a1', 'q.v')})")
    walls = f"flatten(transform(rings, r -> flatten(transform({ring_edges('r')}, e -> {wall}))))"
    apex = vertex("_c.x", "_c.y", f"_z + height + least(greatest(height div 3, {RISE}L), {style.roof_rise}L)", top, style, offset)
    hip = named(apex, "apex", f"transform({ring_edges('rings[0]')}, (e, i) -> {face(corner('e.a', 'height'), corner('e.b', 'height'), 'apex', chosen(style.roof_faces, 'i + _v2'))})")
    trees = tree_centres(known.where("class = 'vegetation'"), style.tree_spacing, ("id", "part", "height", "_v3", "_v4"))
    crowns, shade = crown(style, offset)
    emitted = [
        filled_rows(known, 0, "0L", GROUND, placed(0, "_layer"), "_colour"), made(trees, 1, "n", CROWN, crowns), made(house, 2, "0L", WALL, walls), made(house.where("_hip"), 4, "0L", ROOF, hip),
        filled_rows(house.where("NOT _hip"), 4, "0L", ROOF, placed("height", top), style.building[0]), filled_rows(house, 0, "0L", SHADOW, placed(0, LAYERS["terrain"], style.shadow_x, style.shadow_y), style.shadow), filled_rows(trees, 1, "n", SHADOW, shade, style.shadow),
    ]
    if style.facade:
        quads = facades(house.select("id", "part", "rings", "height"), style.facade)
        upright = lambda side, end: vertex(f"x{side}", f"y{side}", f"z + {end}", top, style, offset)
        pane = named(f"named_struct('a', {upright(0, 'low')}, 'b', {upright(1, 'low')}, 'c', {upright(1, 'high')}, 'd', {upright(0, 'high')})", "q", f"array({face('q.a', 'q.b', 'q.c', 'v')}, {face('q.a', 'q.c', 'q.d', 'v')})")
        emitted.append(made(quads, 3, "n", DETAIL, pane))
    rows = emitted[0]
    for other in emitted[1:]:
        rows = rows.unionAll(other)
    before = Window.partitionBy("id", F.col("stage") == SHADOW).orderBy("part", "_order", "_seq").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.where(F.size("faces") > 0).withColumn("_from", F.coalesce(F.sum(F.size("faces").cast("bigint")).over(before), F.lit(0).cast("bigint")))
    return numbered.select("id", "stage", "_from", F.posexplode("faces").alias("_i", "_f")).select("id", "stage", (F.col("_from") + F.col("_i")).alias("ordinal"), "_f.*")


def keys(ids: np.ndarray, stages: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    """The key of each object's n-th primitive of a stage, never 0."""
    as_bits = lambda x: x.astype(np.int64).view(np.uint64)
    x = as_bits(ids) ^ (as_bits(stages) * np.uint64(KEY_STAGE)) ^ (as_bits(ordinals) * np.uint64(KEY_ORDINAL))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    x ^= x >> np.uint64(31)
    return np.maximum(x, np.uint64(1))


class Surface:
    """The depth buffer of one tile: colours, depths, keys and shadows of side x side pixels from (left, top) of the layout on."""

    def __init__(self, left: int, top: int, width: int, height: int):
        self.left, self.top, self.width, self.height = left, top, width, height
        size = width * height
        self.depth = np.full(size, np.iinfo(np.int64).min)
        self.key = np.zeros(size, np.uint64)
        self.colour = np.zeros(size, np.uint8)
        self.shade = np.zeros(size, bool)
        self.drawn = 0

    def put(self, at: np.ndarray, depth: np.ndarray, key: np.ndarray, colour: np.ndarray) -> None:
        """Takes over what lies on top, in the batch and against what is there."""
        order = np.lexsort((key, -depth, at))
        at, depth, key, colour = at[order], depth[order], key[order], colour[order]
        first = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
        at, depth, key, colour = at[first], depth[first], key[first], colour[first]
        over = (depth > self.depth[at]) | ((depth == self.depth[at]) & (key < self.key[at]))
        at = at[over]
        self.depth[at], self.key[at], self.colour[at] = depth[over], key[over], colour[over]

    def draw(self, t: np.ndarray, key: np.ndarray, colour: np.ndarray, shadow: np.ndarray) -> None:
        """t: rows of (x, y, depth) of three corners."""
        self.drawn += len(t)
        t = t.astype(np.int64).reshape(-1, 3, 3).copy()
        t[:, :, 0] -= self.left * SUBPIXELS
        t[:, :, 1] -= self.top * SUBPIXELS
        x, y, d = t[:, :, 0], t[:, :, 1], t[:, :, 2]
        area = (x[:, 1] - x[:, 0]) * (y[:, 2] - y[:, 0]) - (y[:, 1] - y[:, 0]) * (x[:, 2] - x[:, 0])
        back = area < 0
        t[back] = t[back][:, [0, 2, 1]]
        area = np.abs(area)
        low = np.maximum((y.min(axis=1) - SAMPLE) // SUBPIXELS, 0)
        high = np.minimum((y.max(axis=1) - SAMPLE) // SUBPIXELS, self.height - 1)
        rows = np.maximum(high - low + 1, 0)
        ends = np.cumsum(rows)
        start = 0
        while start < len(t):
            # So many triangles that their rows fill a chunk at most, one at least.
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + max(1, CHUNK // self.width), "right")))
            self.spans(t[start:stop], area[start:stop], low[start:stop], rows[start:stop], key[start:stop], colour[start:stop], shadow[start:stop])
            start = stop

    def spans(self, t, area, low, rows, key, colour, shadow) -> None:
        """Solves the span of covered samples for each row of each triangle and draws its pixels."""
        x, y, d = t[:, :, 0], t[:, :, 1], t[:, :, 2]
        of = np.repeat(np.arange(len(t)), rows)
        py = (low[of] + np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows)) * SUBPIXELS + SAMPLE
        left, right = np.zeros(len(of), np.int64), np.full(len(of), self.width - 1)
        for i in range(3):
            a, b = (i + 1) % 3, (i + 2) % 3
            dx, dy = x[of, b] - x[of, a], y[of, b] - y[of, a]
            # A sample on the edge counts if the edge goes up, or to the right.
            least = np.where((dy > 0) | ((dy == 0) & (dx > 0)), 0, 1)
            # The weight at pixel p of the row is c - dy * (256 p + 128); it must reach least.
            c = dx * (py - y[of, a]) + dy * x[of, a] - dy * SAMPLE - least
            step = np.maximum(np.abs(dy) * SUBPIXELS, 1)
            right = np.where(dy > 0, np.minimum(right, c // step), right)
            left = np.where(dy < 0, np.maximum(left, -(c // step)), left)
            right = np.where((dy == 0) & (c < 0), -1, right)
        n = np.maximum(right - left + 1, 0)
        some = n > 0
        of, py, left, n = of[some], py[some], left[some], n[some]
        px = np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of, py = np.repeat(of, n), np.repeat(py, n)
        at = (py - SAMPLE) // SUBPIXELS * self.width + px
        dark = shadow[of]
        self.shade[at[dark]] = True
        of, py, at, sx = of[~dark], py[~dark], at[~dark], px[~dark] * SUBPIXELS + SAMPLE
        w1 = (x[of, 0] - x[of, 2]) * (py - y[of, 2]) - (y[of, 0] - y[of, 2]) * (sx - x[of, 2])
        w2 = (x[of, 1] - x[of, 0]) * (py - y[of, 0]) - (y[of, 1] - y[of, 0]) * (sx - x[of, 0])
        d1, d2, whole = d[of, 1] - d[of, 0], d[of, 2] - d[of, 0], area[of]
        if len(of) and int(whole.max()) * (int(np.abs(d1).max()) + int(np.abs(d2).max())) >= 2**62:
            w1, w2, whole = (v.astype(object) for v in (w1, w2, whole))
        part = w1 * d1 + w2 * d2
        depth = d[of, 0] + part // whole
        depth = (depth + ((depth < 0) & (part % whole != 0))).astype(np.int64)  # truncated towards zero
        self.put(at, depth, key[of], colour[of])

    def merge(self, row: dict) -> None:
        at = np.frombuffer(row["at"], np.int64)
        self.put(at, np.frombuffer(row["depth"], np.int64), np.frombuffer(row["key"], np.uint64), np.frombuffer(row["colour"], np.uint8))
        self.shade |= np.unpackbits(np.frombuffer(row["shade"], np.uint8), count=len(self.shade)).astype(bool)
        self.drawn += row["drawn"]

    def partial(self) -> dict:
        at = np.flatnonzero(self.depth > np.iinfo(np.int64).min)
        return {"drawn": self.drawn, "at": at.tobytes(), "depth": self.depth[at].tobytes(), "key": self.key[at].tobytes(), "colour": self.colour[at].tobytes(), "shade": np.packbits(self.shade).tobytes()}

    def composed(self, style: Style, offset: tuple[int, int], guard: int, size: tuple[int, int]) -> bytes:
        """The core's pixels with shadows, patterns and outlines; size: the whole picture's."""
        image = self.colour.reshape(self.height, self.width).copy()
        image[self.shade.reshape(image.shape) & np.isin(image, style.eligible())] = style.shadow
        # Patterns lie still in the world.
        gx, gy = np.arange(self.width) + self.left, np.arange(self.height) + self.top
        ax, ay = (gx * SUBPIXELS - offset[0]).astype(np.int64), (gy * SUBPIXELS - offset[1]).astype(np.int64)
        turned = ax.view(np.uint64)
        turned = turned << np.uint64(13) | turned >> np.uint64(51)
        x = turned[None, :] ^ ay.view(np.uint64)[:, None]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
        x ^= x >> np.uint64(31)
        up = (ax // SUBPIXELS)[None, :] + (ay // SUBPIXELS)[:, None]
        flat = image.copy()
        image[(flat == style.terrain[0]) & (x % np.uint64(style.terrain_dither) == 0)] = style.terrain[1]
        image[(flat == style.athletic[0]) & (x % np.uint64(style.athletic_dither) == 0)] = style.athletic[1]
        image[(flat == style.parking[0]) & (up % style.parking_lines == 0)] = style.parking[1]
        family = style.families()[image]
        wide = np.pad(family, 1)
        other = (wide[1:-1, :-2] != family) | (wide[1:-1, 2:] != family) | (wide[:-2, 1:-1] != family) | (wide[2:, 1:-1] != family)
        inner = ((gx > 0) & (gx < size[0] - 1))[None, :] & ((gy > 0) & (gy < size[1] - 1))[:, None]
        image[(family != 0) & other & inner] = style.outline
        return image[guard : self.height - guard, guard : self.width - guard].tobytes()


def dealt(faces: DataFrame, tile: int, guard: int, width: int, height: int) -> DataFrame:
    """faces with col and row of every tile whose guarded pixels its box may touch."""
    reach = lambda c, pick: pick(*[F.col(f"{p}.{c}") for p in "abc"])
    first = lambda c: F.greatest(floor_div(floor_div(reach(c, F.least) - SAMPLE, SUBPIXELS) - guard, tile), F.lit(0))
    last = lambda c, n: F.least(floor_div(floor_div(reach(c, F.greatest), SUBPIXELS) + guard, tile), F.lit((n - 1) // tile))
    # Out of an array the box is finished: the tests of it and of the sequences do not work it out again.
    box = F.struct(first("x").alias("c0"), last("x", width).alias("c1"), first("y").alias("r0"), last("y", height).alias("r1"))
    boxed = faces.withColumn("_b", F.explode(F.array(box))).where("_b.c0 <= _b.c1 and _b.r0 <= _b.r1")
    return boxed.withColumn("col", F.explode(F.sequence("_b.c0", "_b.c1"))).withColumn("row", F.explode(F.sequence("_b.r0", "_b.r1"))).drop("_b")


def render(objects: DataFrame, style: Style, tile: int = 512, guard: int = 1, piece: int = PIECE) -> DataFrame:
    """The tiles of the picture of all objects: col, row, width, height, pixels (row-major palette indexes) and drawn.

    drawn: triangles that met the tile, shadows included. Tiles that nothing meets are there too, all background (0). No
    objects give no tiles. guard: pixels around a tile that are drawn for the outlines' sake; 1 is enough for these.
    """
    at = layout(objects, style)
    spark = objects.sparkSession
    shape = "col bigint, row bigint, width bigint, height bigint, drawn bigint, pixels binary"
    if at is None:
        return spark.createDataFrame([], shape)
    offset, (width, height) = at[:2], at[2:]
    parts = ["at", "depth", "key", "colour", "shade"]
    faces = written(dealt(triangles(objects, style, offset), tile, guard, width, height), "faces")
    many = faces.groupBy("col", "row").agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces"))
    flat = [F.col(f"{p}.{c}").alias(f"{c}{i}") for i, p in enumerate("abc") for c in ("x", "y", "depth")]
    # Pieces by object, so that what a piece holds does not change with partitions.
    split = faces.join(many, ["col", "row"]).select("col", "row", "pieces", F.pmod(F.xxhash64("id", "ordinal"), F.col("pieces")).cast("int").alias("piece"), "id", "stage", "ordinal", "v", *flat)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = split.repartition(n, "col", "row", "piece").sortWithinPartitions("col", "row", "piece")

    def surface(col: int, row: int) -> Surface:
        w, h = min(tile, width - col * tile), min(tile, height - row * tile)
        return Surface(col * tile - guard, row * tile - guard, w + 2 * guard, h + 2 * guard)

    def done(col: int, row: int, s: Surface) -> dict:
        return {"col": col, "row": row, "width": s.width - 2 * guard, "height": s.height - 2 * guard, "drawn": s.drawn, "pixels": s.composed(style, offset, guard, (width, height))}

    fields = [("col", pa.int64()), ("row", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("drawn", pa.int64()), ("pixels", pa.binary())]
    loose = pa.schema(fields + [(p, pa.binary()) for p in parts])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, s = None, None

        def out() -> pa.RecordBatch:
            col, row, pieces, _ = now
            # A tile of one piece is finished here; others give their buffers.
            return pa.RecordBatch.from_pylist([done(col, row, s)] if pieces == 1 else [{"col": col, "row": row, **s.partial()}], loose)

        for batch in batches:
            c = {name: batch.column(name).to_numpy() for name in batch.schema.names}
            place = np.column_stack([c["col"], c["row"], c["pieces"], c["piece"]])
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
            corners = np.column_stack([c[f"{a}{i}"] for i in range(3) for a in ("x", "y", "depth")])
            key, dark = keys(c["id"], c["stage"], c["ordinal"]), c["stage"] == SHADOW
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(place)], strict=True):
                if a == b:
                    continue
                here = tuple(int(v) for v in place[a])
                if here != now:
                    if now is not None:
                        yield out()
                    now, s = here, surface(here[0], here[1])
                s.draw(corners[a:b], key[a:b], c["v"][a:b].astype(np.uint8), dark[a:b])
        if now is not None:
            yield out()

    drawn = written(ordered.mapInArrow(draw, shape + "".join(f", {p} binary" for p in parts)), "drawn")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, s = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                if now != (row["col"], row["row"]):
                    if now is not None:
                        yield pa.RecordBatch.from_pylist([done(*now, s)], pa.schema(fields))
                    now = (row["col"], row["row"])
                    s = surface(*now)
                s.merge(row)
        if now is not None:
            yield pa.RecordBatch.from_pylist([done(*now, s)], pa.schema(fields))

    whole = drawn.where("pixels is not null").select(*[f[0] for f in fields])
    merged = drawn.where("pixels is null").repartition(n, "col", "row").sortWithinPartitions("col", "row").mapInArrow(merge, shape)
    tiles = whole.unionByName(merged)
    grid = spark.range((width - 1) // tile + 1).withColumnRenamed("id", "col").withColumn("row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((height - 1) // tile).cast("bigint"))))
    size = lambda c, whole_: F.least(F.lit(tile), whole_ - F.col(c) * tile).cast("bigint")
    sized = grid.withColumns({"width": size("col", F.lit(width)), "height": size("row", F.lit(height))})
    empty = F.unhex(F.repeat(F.lit("00"), (F.col("width") * F.col("height")).cast("int")))
    return sized.join(tiles.select("col", "row", "drawn", "pixels"), ["col", "row"], "left").select("col", "row", "width", "height", F.coalesce("drawn", F.lit(0).cast("bigint")).alias("drawn"), F.coalesce("pixels", empty).alias("pixels"))
