"""Queries of the scene renderer and of published pyramids, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.durable import shared_dir
from loamgrid.operators import facades, landmarks, publish, render
from loamgrid.plans.inputs import RASTERS_SQL, rasters, table
from loamgrid.plans.registry import query

STYLE = render.Style(step=2_000, rise=2_000)
TILE = 64
_NAMES = ["terrain", "building", "vegetation", "road", "water", "building", "parking", "athletic-surface", "path"]
#: Rings by part and number, as expressions of id, k (corner), cx and cy: a star of eight corners, a square hole in every
#: fourth object, and a second part beside every fifth.
_DX = "CASE k % 8 WHEN 0 THEN 1000 WHEN 1 THEN 707 WHEN 2 THEN 0 WHEN 3 THEN -707 WHEN 4 THEN -1000 WHEN 5 THEN -707 WHEN 6 THEN 0 ELSE 707 END"
_DY = "CASE k % 8 WHEN 0 THEN 0 WHEN 1 THEN 707 WHEN 2 THEN 1000 WHEN 3 THEN 707 WHEN 4 THEN 0 WHEN 5 THEN -707 WHEN 6 THEN -1000 ELSE -707 END"
_R = "(3 + (id * 7919 + k % 8 * 104729) % 6)"
_SQUARE = ("CASE k % 4 WHEN 0 THEN -1000 WHEN 1 THEN 1000 WHEN 2 THEN 1000 ELSE -1000 END", "CASE k % 4 WHEN 0 THEN -1000 WHEN 1 THEN -1000 WHEN 2 THEN 1000 ELSE 1000 END")
RINGS = [(0, 0, 9, "TRUE", f"cx + {_R} * ({_DX})", f"cy + {_R} * ({_DY})"), (0, 1, 5, "id % 4 = 0", f"cx + ({_SQUARE[0]})", f"cy + ({_SQUARE[1]})"), (1, 0, 5, "id % 5 = 0", f"cx + 11000 + 2 * ({_SQUARE[0]})", f"cy + ({_SQUARE[1]})")]
_Z = "id % 3 * 500"
_HEIGHT = "CASE WHEN id % 10 = 1 THEN 0 ELSE p_size * 300 END"


def world(spark, sf) -> DataFrame:
    """Objects made of parts: id, class, height and parts, polygons of rings of points x, y, z."""
    o = table(spark, sf, "part").selectExpr("p_partkey AS id", "p_size", "p_partkey * 7919 % 600000 AS cx", "p_partkey * 50021 % 600000 AS cy")

    def ring(n: int, x: str, y: str) -> str:
        return f"transform(sequence(0L, {n - 1}L), k -> named_struct('x', CAST({x} AS BIGINT), 'y', CAST({y} AS BIGINT), 'z', CAST({_Z} AS BIGINT)))"

    star, hole, side = (ring(n, x, y) for _, _, n, _, x, y in RINGS)
    parts = f"CASE WHEN {RINGS[2][3]} THEN array(rings, array({side})) ELSE array(rings) END"
    names = ", ".join(f"'{n}'" for n in _NAMES)
    o = o.selectExpr("*", f"CASE WHEN {RINGS[1][3]} THEN array({star}, {hole}) ELSE array({star}) END AS rings")
    return o.selectExpr("id", f"element_at(array({names}), CAST(id % 9 AS INT) + 1) AS class", f"CAST({_HEIGHT} AS BIGINT) AS height", f"{parts} AS parts")


_S = STYLE
_COLOURS = _S.colours()
_CASE = lambda d, of: f"CASE {of} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in d.items()) + " END"
_SX = lambda x, y: f"(({x}) - ({y})) * 256 // {_S.step}"
_SY = lambda x, y, z: f"((({x}) + ({y})) * 256 // {_S.step}) // 2 - ({z}) * 256 // {_S.rise}"
_U = lambda x, s, m: f"((xor(({x})::UBIGINT, ({x})::UBIGINT >> {s}))::UHUGEINT * {m} % 18446744073709551616)"
_BITS = lambda x: f"((({x})::HUGEINT + 18446744073709551616) % 18446744073709551616)"
_ROTATE = lambda x, k: f"(({x})::UHUGEINT * {2**k} % 18446744073709551616 + ({x})::UHUGEINT // {2 ** (64 - k)})"
_VARY = lambda x, n: f"(xor({_U(x, 33, 18397679294719823053)}::UBIGINT, {_U(x, 33, 18397679294719823053)}::UBIGINT >> 33) % {n})::BIGINT"
_MIXED = lambda x: _U(_U(x, 30, 13787848793156543929), 27, 10723151780598845931)
_FOLD = lambda c: f"xor({c}::UBIGINT, {c}::UBIGINT >> 31)"
_PICK = lambda options, i: f"[{', '.join(map(str, options))}][({i}) % {len(options)} + 1]"
_EDGE = lambda a, b, x, y: f"((x{b} - x{a})::HUGEINT * ({y} - y{a}) - (y{b} - y{a})::HUGEINT * ({x} - x{a}))"

OBJECTS_SQL = f"""obj AS (SELECT *, p_partkey AS id, {_PICK([f"'{n}'" for n in _NAMES], 'p_partkey % 9')} AS class, p_partkey * 7919 % 600000 AS cx, p_partkey * 50021 % 600000 AS cy FROM part),
o AS (SELECT id, cx, cy, class, {_CASE(render.LAYERS, 'class')} AS layer, {_CASE(_COLOURS, 'class')} AS colour, {_HEIGHT} AS height FROM obj),
pt AS ({' UNION ALL '.join(f"SELECT id, {p} AS part, {r} AS ring, k, {x} AS x, {y} AS y, {_Z} AS z FROM o, range({n}) t(k) WHERE {when}" for p, r, n, when, x, y in RINGS)}),
box AS (SELECT id, class, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_, min(z) AS az, max(z) + any_value(height) AS bz FROM pt JOIN o USING (id) GROUP BY id, class),
box2 AS (SELECT id, ax - r AS ax, ay - r + least(s, 0) * {-_S.shadow_y} AS ay, bx + r - least(s, 0) * {_S.shadow_x} AS bx, by_ + r AS by_, az, CASE class WHEN 'vegetation' THEN greatest(bz, az + {_S.tree_height}) WHEN 'building' THEN bz + {_S.roof_rise} ELSE bz END AS bz
  FROM (SELECT *, CASE WHEN class = 'vegetation' THEN {_S.tree_radius + 1000} ELSE 0 END AS r, CASE WHEN class IN ('vegetation', 'building') THEN -1 ELSE 0 END AS s FROM box)),
scr AS (SELECT id, {_SX('ax', 'by_')} AS min_x, {_SY('ax', 'ay', 'bz')} AS min_y, {_SX('bx', 'ay')} AS max_x, {_SY('bx', 'by_', 'az')} AS max_y FROM box2),
lay AS (SELECT 8192 - min(min_x) AS ox, 8192 - min(min_y) AS oy, (max(max_x) - min(min_x) + 16384 + 255) // 256 AS w, (max(max_y) - min(min_y) + 16384 + 255) // 256 AS h FROM scr)"""

TREES_SQL = f"""tb AS (SELECT id, part, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pt JOIN o USING (id) WHERE class = 'vegetation' AND ring = 0 GROUP BY id, part),
tf AS (SELECT *, x0 - ((x0 % {_S.tree_spacing}) + {_S.tree_spacing}) % {_S.tree_spacing} AS fx, y0 - ((y0 % {_S.tree_spacing}) + {_S.tree_spacing}) % {_S.tree_spacing} AS fy FROM tb),
tg AS (SELECT id, part, a * 1000 + b AS n, fx + a * {_S.tree_spacing} AS gx, fy + b * {_S.tree_spacing} AS gy FROM tf, range(12) s(a), range(12) t(b) WHERE fx + a * {_S.tree_spacing} <= x1 AND fy + b * {_S.tree_spacing} <= y1),
ts AS (SELECT *, {_MIXED(f'xor(xor(id::UBIGINT, {_ROTATE(_BITS("gx"), 17)}::UBIGINT), {_BITS("gy")}::UBIGINT)')} AS m FROM tg), th AS (SELECT *, {_FOLD('m')} AS hh FROM ts),
tp AS (SELECT id, part, n, gx + (hh % {_S.tree_spacing // 5 * 2 + 1})::BIGINT - {_S.tree_spacing // 5} AS px, gy + ({_ROTATE('hh', 29)} % {_S.tree_spacing // 5 * 2 + 1})::BIGINT - {_S.tree_spacing // 5} AS py FROM th),
we AS (SELECT * FROM (SELECT id, part, ring, k, x AS ax, y AS ay, z AS az, lead(x) OVER w AS ux, lead(y) OVER w AS uy, lead(z) OVER w AS uz FROM pt WINDOW w AS (PARTITION BY id, part, ring ORDER BY k)) WHERE ux IS NOT NULL),
tin AS (SELECT tp.id, tp.part, n, px, py, ring, sum(CASE WHEN (ay > py) <> (uy > py) AND (CASE WHEN uy > ay THEN (ux - ax)::HUGEINT * (py - ay) - (uy - ay)::HUGEINT * (px - ax) > 0 ELSE (ux - ax)::HUGEINT * (py - ay) - (uy - ay)::HUGEINT * (px - ax) < 0 END) THEN 1 ELSE 0 END) % 2 = 1 AS hit
  FROM tp JOIN we ON tp.id = we.id AND tp.part = we.part GROUP BY ALL),
tree AS (SELECT id, part, n, px, py, greatest(any_value(height), {_S.tree_height}) AS tall, {_S.tree_radius} + {_VARY('id', 3)} * 500 AS r, {_VARY('id', 4)} AS v4 FROM tin JOIN o USING (id) GROUP BY id, part, n, px, py HAVING bool_and(hit = (ring = 0)))"""

_CORNERS = "[" + ", ".join(f"{{'x': {x}, 'y': {y}}}" for x, y in render.CORNERS) + "]"
_V = lambda x, y, z, layer: f"{{'x': {_SX(x, y)} + ox, 'y': {_SY(x, y, z)} + oy, 'd': (({x}) + ({y}) + ({z})) * 16 + {layer}}}"
FACES_SQL = f"""poly AS (SELECT id, part, 0 AS ord, 0::BIGINT AS seq, 1 AS stage, colour AS v, ring, k, {_V('x', 'y', 'z', 'layer')} AS p FROM pt JOIN o USING (id), lay
  UNION ALL SELECT id, part, 0, 0, 5, {_S.shadow}, ring, k, {_V(f'x + {_S.shadow_x}', f'y + {_S.shadow_y}', 'z', 1)} FROM pt JOIN o USING (id), lay WHERE class = 'building' AND height > 0
  UNION ALL SELECT id, part, 3, 0, 3, {_S.building[0]}, ring, k, {_V('x', 'y', 'z + height', 7)} FROM pt JOIN o USING (id) LEFT JOIN hip USING (id, part), lay WHERE class = 'building' AND height > 0 AND hip.id IS NULL
  UNION ALL SELECT id, part, 1, n, 5, {_S.shadow}, 0, k, {_V(f'px + {_S.shadow_x} + {_CORNERS}[k + 1].x * {_S.tree_radius} // 1000', f'py + {_S.shadow_y} + {_CORNERS}[k + 1].y * {_S.tree_radius} // 1000', '0', 1)} FROM tree, range(9) t(k), lay),
pe AS (SELECT *, row_number() OVER (PARTITION BY id, part, ord, seq, stage ORDER BY ring, k) AS i FROM (SELECT id, part, ord, seq, stage, v, ring, k, p AS a, lead(p) OVER (PARTITION BY id, part, ord, seq, stage, ring ORDER BY k) AS b FROM poly) WHERE b IS NOT NULL),
lv AS (SELECT id, part, ord, seq, stage, y AS low, lead(y) OVER (PARTITION BY id, part, ord, seq, stage ORDER BY y) AS high FROM (SELECT DISTINCT id, part, ord, seq, stage, p.y AS y FROM poly)),
cr AS (SELECT e.*, low, high, a.x + (b.x - a.x) * (low - a.y) // (b.y - a.y) AS lx, a.d + (b.d - a.d) * (low - a.y) // (b.y - a.y) AS ld, a.x + (b.x - a.x) * (high - a.y) // (b.y - a.y) AS hx, a.d + (b.d - a.d) * (high - a.y) // (b.y - a.y) AS hd
  FROM lv JOIN pe e USING (id, part, ord, seq, stage) WHERE high IS NOT NULL AND a.y <> b.y AND least(a.y, b.y) <= low AND greatest(a.y, b.y) >= high),
rk AS (SELECT *, row_number() OVER (PARTITION BY id, part, ord, seq, stage, low ORDER BY lx + hx, i) AS n FROM cr),
pr AS (SELECT l.id, l.part, l.ord, l.seq, l.stage, l.v, l.low, l.high, l.n, l.lx, l.ld, l.hx, l.hd, r.lx AS rlx, r.ld AS rld, r.hx AS rhx, r.hd AS rhd FROM rk l JOIN rk r ON l.id = r.id AND l.part = r.part AND l.ord = r.ord AND l.seq = r.seq AND l.stage = r.stage AND l.low = r.low AND r.n = l.n + 1 WHERE l.n % 2 = 1),
lift AS (SELECT w.*, ux - ax >= uy - ay AS light, {_V('ax', 'ay', 'az', 7)} AS a0, {_V('ux', 'uy', 'uz', 7)} AS b0, {_V('ax', 'ay', 'az + height', 7)} AS a1, {_V('ux', 'uy', 'uz + height', 7)} AS b1 FROM we w JOIN o USING (id), lay WHERE class = 'building' AND height > 0),
apex AS (SELECT id, part, {_V('mx', 'my', f'mz + height + least(greatest(height // 3, 1500), {_S.roof_rise})', 7)} AS p FROM (SELECT id, part, any_value(height) AS height, sum(ax)::BIGINT // count(*) AS mx, sum(ay)::BIGINT // count(*) AS my, sum(az)::BIGINT // count(*) AS mz FROM we JOIN hip USING (id, part) JOIN o USING (id) GROUP BY id, part), lay),
cv AS (SELECT id, part, n, i, v4, {_V(f'px + {_CORNERS}[i + 1].x * r // 1000', f'py + {_CORNERS}[i + 1].y * r // 1000', 'tall // 3', 3)} AS lo, {_V(f'px + {_CORNERS}[i + 1].x * (r * 2 // 3) // 1000', f'py + {_CORNERS}[i + 1].y * (r * 2 // 3) // 1000', 'tall * 5 // 6', 3)} AS hi, {_V('px', 'py', 'tall', 3)} AS top FROM tree, range(9) t(i), lay),
cf AS (SELECT a.id, a.part, a.n, a.i, a.v4, a.lo AS l0, b.lo AS l1, a.hi AS h0, b.hi AS h1, a.top FROM cv a JOIN cv b ON a.id = b.id AND a.part = b.part AND a.n = b.n AND b.i = a.i + 1),
fc AS (SELECT id, part, ord, seq, stage, [low, n, 0] AS sub, {{'x': lx, 'y': low, 'd': ld}} AS a, {{'x': rlx, 'y': low, 'd': rld}} AS b, {{'x': rhx, 'y': high, 'd': rhd}} AS c, v FROM pr
  UNION ALL SELECT id, part, ord, seq, stage, [low, n, 1], {{'x': lx, 'y': low, 'd': ld}}, {{'x': rhx, 'y': high, 'd': rhd}}, {{'x': hx, 'y': high, 'd': hd}}, v FROM pr
  UNION ALL SELECT id, part, 2, 0, 2, [ring, k, 0], a0, b0, b1, CASE WHEN light THEN {_S.building[1]} ELSE {_S.building[2]} END FROM lift UNION ALL SELECT id, part, 2, 0, 2, [ring, k, 1], a0, b1, a1, CASE WHEN light THEN {_S.building[1]} ELSE {_S.building[2]} END FROM lift
  UNION ALL SELECT l.id, l.part, 3, 0, 3, [k, 0, 0], a1, b1, apex.p, {_PICK(_S.roof_faces, f'k + {_VARY("l.id", 2)}')} FROM lift l JOIN apex ON l.id = apex.id AND l.part = apex.part
  UNION ALL SELECT id, part, 1, n, 4, [i, 0, 0], l0, l1, h1, {_PICK(_S.canopy, 'i + v4')} FROM cf UNION ALL SELECT id, part, 1, n, 4, [i, 1, 0], l0, h1, h0, {_PICK(_S.canopy, 'i + v4')} FROM cf UNION ALL SELECT id, part, 1, n, 4, [i, 2, 0], h0, h1, top, {_PICK(_S.canopy, 'i')} FROM cf),
tri AS (SELECT *, row_number() OVER (PARTITION BY id, stage = 5 ORDER BY part, ord, seq, sub) - 1 AS ordinal FROM fc WHERE (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) <> 0)"""
#: A part's roof is hipped if it has one ring that never turns both ways.
HIP_SQL = """hip AS (SELECT id, part FROM (SELECT a.id, a.part, a.ring, sign((a.ux - a.ax)::HUGEINT * (b.uy - a.uy) - (a.uy - a.ay)::HUGEINT * (b.ux - a.ux)) AS s FROM we a JOIN we b ON a.id = b.id AND a.part = b.part AND a.ring = b.ring
  AND b.k = (a.k + 1) % (SELECT count(*) FROM we c WHERE c.id = a.id AND c.part = a.part AND c.ring = a.ring)) GROUP BY id, part HAVING max(ring) = 0 AND NOT (bool_or(s > 0) AND bool_or(s < 0)))"""
_KEY = lambda i, p, o: f"xor(xor(({i})::UBIGINT, (({p})::UHUGEINT * {render.KEY_STAGE} % 18446744073709551616)::UBIGINT), (({o})::UHUGEINT * {render.KEY_ORDINAL} % 18446744073709551616)::UBIGINT)"
_HOLDS = lambda w, a, b: f"(w{w} > 0 OR (w{w} = 0 AND (y{a} < y{b} OR (y{a} = y{b} AND x{a} < x{b}))))"
_MOD = lambda a, n: f"((({a}) % {n} + {n}) % {n})"
_FLOOR = lambda a, n: f"(({a}) - {_MOD(a, n)}) // {n}"
PICTURE_SQL = f"""{OBJECTS_SQL}, {TREES_SQL}, {HIP_SQL}, {FACES_SQL},
t0 AS (SELECT stage, v, {_MIXED(_KEY('id', 'stage', 'ordinal'))} AS km, a.x AS x0, a.y AS y0, a.d AS d0, b.x AS bx, b.y AS by_, b.d AS bd, c.x AS cx, c.y AS cy, c.d AS cd FROM tri),
t1 AS (SELECT stage, v, {_FOLD('km')} AS key, x0, y0, d0, (bx - x0)::HUGEINT * (cy - y0) - (by_ - y0)::HUGEINT * (cx - x0) AS ar, bx, by_, bd, cx, cy, cd FROM t0),
t2 AS (SELECT stage, v, key, x0, y0, d0, abs(ar) AS area, CASE WHEN ar < 0 THEN cx ELSE bx END AS x1, CASE WHEN ar < 0 THEN cy ELSE by_ END AS y1, CASE WHEN ar < 0 THEN cd ELSE bd END AS d1, CASE WHEN ar < 0 THEN bx ELSE cx END AS x2, CASE WHEN ar < 0 THEN by_ ELSE cy END AS y2, CASE WHEN ar < 0 THEN bd ELSE cd END AS d2 FROM t1),
ty AS (SELECT t2.*, unnest(range(greatest((least(y0, y1, y2) - 128) // 256, 0), least((greatest(y0, y1, y2) - 128) // 256, h - 1) + 1)) AS y, w FROM t2, lay),
tx AS (SELECT *, unnest(range(greatest((least(x0, x1, x2) - 128) // 256, 0), least((greatest(x0, x1, x2) - 128) // 256, w - 1) + 1)) AS x FROM ty),
px AS (SELECT *, {_EDGE(1, 2, 'x * 256 + 128', 'y * 256 + 128')} AS w0, {_EDGE(2, 0, 'x * 256 + 128', 'y * 256 + 128')} AS w1, {_EDGE(0, 1, 'x * 256 + 128', 'y * 256 + 128')} AS w2 FROM tx),
inn AS (SELECT stage, y, x, v, key, (w0 * d0 + w1 * d1 + w2 * d2) // area AS depth FROM px WHERE {_HOLDS(0, 1, 2)} AND {_HOLDS(1, 2, 0)} AND {_HOLDS(2, 0, 1)}),
main AS (SELECT y, x, arg_max(v, {{'d': depth, 'k': 18446744073709551615::UBIGINT - key}}) AS v FROM inn WHERE stage <> 5 GROUP BY y, x), dark AS (SELECT DISTINCT y, x, TRUE AS s FROM inn WHERE stage = 5),
im1 AS (SELECT y, x, ox, oy, w, h, CASE WHEN s AND coalesce(v, 0) IN ({', '.join(map(str, _S.eligible()))}) THEN {_S.shadow} ELSE coalesce(v, 0) END AS v FROM (SELECT y, x, ox, oy, w, h FROM (SELECT *, unnest(range(h)) AS y FROM lay), range((SELECT w FROM lay)) b(x)) grid LEFT JOIN main USING (y, x) LEFT JOIN dark USING (y, x)),
im2 AS (SELECT *, x * 256 - ox AS ax, y * 256 - oy AS ay FROM im1), im3 AS (SELECT *, {_MIXED(f'xor({_ROTATE(_BITS("ax"), 13)}::UBIGINT, {_BITS("ay")}::UBIGINT)')} AS m FROM im2),
im4 AS (SELECT y, x, w, h, CASE WHEN v = {_S.terrain[0]} AND {_FOLD('m')} % {_S.terrain_dither} = 0 THEN {_S.terrain[1]} WHEN v = {_S.athletic[0]} AND {_FOLD('m')} % {_S.athletic_dither} = 0 THEN {_S.athletic[1]} WHEN v = {_S.parking[0]} AND {_MOD(f"{_FLOOR('ax', 256)} + {_FLOOR('ay', 256)}", _S.parking_lines)} = 0 THEN {_S.parking[1]} ELSE v END AS v FROM im3),
im5 AS (SELECT *, CASE WHEN v IN ({', '.join(map(str, (*_S.building, *_S.roof_faces)))}) THEN 1 WHEN v IN ({', '.join(map(str, _S.canopy))}) THEN 2 ELSE 0 END AS f FROM im4),
im6 AS (SELECT *, lag(f) OVER r <> f OR lead(f) OVER r <> f OR lag(f) OVER c <> f OR lead(f) OVER c <> f AS other FROM im5 WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y)),
picture AS (SELECT y, x, w, h, CASE WHEN f <> 0 AND other AND x > 0 AND x < w - 1 AND y > 0 AND y < h - 1 THEN {_S.outline} ELSE v END AS v FROM im6)"""


@query("sg12_sg1_scene_tiles", f"WITH {PICTURE_SQL} SELECT x // {TILE} AS col, y // {TILE} AS row, count(DISTINCT x) AS width, count(DISTINCT y) AS height, count_if(v > 0) AS lit, sha256(string_agg(printf('%02X', v), '' ORDER BY y, x)) AS sha256 FROM picture GROUP BY ALL")
def scene_tiles(spark, sf) -> DataFrame:
    tiles = render.render(world(spark, sf), STYLE, TILE)
    hexed = F.hex("pixels")
    lit = F.size(F.filter(F.regexp_extract_all(hexed, F.lit("(..)"), F.lit(1)), lambda p: p != "00")).cast("bigint")
    return tiles.select("col", "row", "width", "height", lit.alias("lit"), F.sha2(hexed, 256).alias("sha256"))


@query("ge8_ag13_layout", f"WITH {OBJECTS_SQL} SELECT id, min_x + ox AS min_x, min_y + oy AS min_y, max_x + ox AS max_x, max_y + oy AS max_y, w AS width, h AS height FROM scr, lay")
def render_bounds(spark, sf) -> DataFrame:
    objects = world(spark, sf)
    ox, oy, width, height = render.layout(objects, STYLE)
    moved = [(F.col(c) + o).alias(c) for c, o in (("min_x", ox), ("min_y", oy), ("max_x", ox), ("max_y", oy))]
    return render.render_bounds(objects, STYLE).select("id", *moved, F.lit(width).cast("bigint").alias("width"), F.lit(height).cast("bigint").alias("height"))


@query("sf8_layout_points", f"WITH {OBJECTS_SQL} SELECT id, part, ring, k, {_FLOOR(_SX('x', 'y') + ' + ox', 256)} AS px, {_FLOOR(_SY('x', 'y', 'z') + ' + oy', 256)} AS py FROM pt, lay")
def layout_points(spark, sf) -> DataFrame:
    objects = world(spark, sf)
    offset = render.layout(objects, STYLE)[:2]
    parts = objects.select("id", F.posexplode("parts").alias("part", "rings")).select("id", "part", F.posexplode("rings").alias("ring", "points"))
    points = parts.select("id", "part", "ring", F.posexplode("points").alias("k", "p"))
    at = render.to_layout(F.col("p.x"), F.col("p.y"), F.col("p.z"), STYLE, offset)
    return points.withColumn("_at", at).select("id", *[F.col(c).cast("int").alias(c) for c in ("part", "ring")], F.col("k").cast("bigint").alias("k"), F.col("_at.x").alias("px"), F.col("_at.y").alias("py"))


#: Pictures of the published pyramids: rasters of 16 colours, in tiles of 16 pixels.
SIDE = 16
IMAGES_SQL = f"{RASTERS_SQL}, img AS (SELECT raster_id AS id, y, x, v % 16 AS v FROM ras), dim AS (SELECT id, max(x) + 1 AS w, max(y) + 1 AS h FROM img GROUP BY id)"
LEVELS_SQL = f"""lev AS (SELECT id, top, level, (w + (1 << (top - level)::INT) - 1) // (1 << (top - level)::INT) AS lw, (h + (1 << (top - level)::INT) - 1) // (1 << (top - level)::INT) AS lh FROM (SELECT *, unnest(range(top + 1)) AS level FROM (SELECT *, ceil(log2(greatest(w, h)))::BIGINT AS top FROM dim))),
lp AS (SELECT l.id, level, i.x >> (top - level)::INT AS x, i.y >> (top - level)::INT AS y, v FROM lev l JOIN img i ON i.id = l.id AND i.x % (1 << (top - level)::INT) = 0 AND i.y % (1 << (top - level)::INT) = 0),
til AS (SELECT id, level, x // {SIDE} AS col, y // {SIDE} AS row, count(DISTINCT x) AS width, count(DISTINCT y) AS height, string_agg(printf('%02x', v), '' ORDER BY y, x) AS body FROM lp GROUP BY ALL),
fil AS (SELECT *, concat('{publish.MAGIC.hex()}', printf('%02x000000', width), printf('%02x000000', height), body) AS hex FROM til)"""


def pictures(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(tiles, sizes) of the rasters: each tile's pixels in one binary."""
    image = rasters(spark, sf).select(F.col("raster_id").alias("id"), "y", "x", (F.col("v") % 16).alias("v"))
    sizes = image.groupBy("id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda p: F.format_string("%02x", p["v"])), "")  # SIDE * SIDE pixels
    tiles = image.groupBy("id", F.expr(f"x div {SIDE}").alias("col"), F.expr(f"y div {SIDE}").alias("row")).agg(F.countDistinct("x").alias("width"), F.countDistinct("y").alias("height"), F.unhex(line).alias("pixels"))
    return tiles, sizes


def published(spark, sf) -> DataFrame:
    return publish.publish(*pictures(spark, sf), SIDE, f"{shared_dir(spark)}/loamgrid/pyramid-{uuid.uuid4().hex}")


@query("hp7_jn10_rk13_pyramid", f"WITH {IMAGES_SQL}, {LEVELS_SQL} SELECT id, level::INT AS level, col, row, width, height, sha256(unhex(hex)) AS sha256, (length(hex) // 2)::BIGINT AS bytes FROM fil")
def pyramid_tiles(spark, sf) -> DataFrame:
    return publish.encoded(published(spark, sf)).drop("pixels", "file")


@query("hp7_ag14_release", f"WITH {IMAGES_SQL}, {LEVELS_SQL} SELECT id, sha256(string_agg(concat(level, '/', col, '_', row, chr(0), sha256(unhex(hex)), chr(10)), '' ORDER BY level, row, col)) AS set_sha256, count(*) AS n, sum(length(hex) // 2)::BIGINT AS bytes FROM fil GROUP BY id")
def release(spark, sf) -> DataFrame:
    return publish.release(published(spark, sf))


FACADE = facades.Facade()
_VARIANT = _FOLD(_MIXED("xor(xor(xor(xor(id::UBIGINT, ring::UBIGINT << 11), edge::UBIGINT << 23), floor::UBIGINT << 37), bay::UBIGINT << 49)"))


@query("sg3_sg4_openings", f"""WITH {OBJECTS_SQL}, {TREES_SQL}, e0 AS (SELECT w.*, k AS edge, height, ux - ax AS dx, uy - ay AS dy, uz - az AS dz, greatest(abs(ux - ax), abs(uy - ay)) AS len FROM we w JOIN o USING (id) WHERE class = 'building' AND height >= {facades.LEAST_HEIGHT}),
e1 AS (SELECT *, least(greatest(len // {FACADE.bay}, 1), {facades.BAYS}) AS bays FROM e0 WHERE len >= {FACADE.window[0] * 2}),
b AS (SELECT *, unnest(range(bays)) AS bay FROM (SELECT *, unnest(range(least(greatest((height - {facades.PLINTH}) // {FACADE.floor}, 1), {facades.FLOORS}))) AS floor FROM e1)),
v AS (SELECT *, {_VARIANT} AS way, {facades.SILL} + floor * {FACADE.floor} AS low, least({facades.SILL} + floor * {FACADE.floor} + {FACADE.window[1]}, height - {facades.EAVES}) AS high, greatest(least({FACADE.window[0] // 2}, len // (bays + 1) // 3), {facades.HALF_WIDTH}) AS half FROM b),
q AS (SELECT v.*, part_, row_number() OVER (PARTITION BY id, part ORDER BY ring, edge, floor, bay, part_) - 1 AS n FROM v, range(2) t(part_) WHERE high > low AND way % {facades.BLANK} <> 0 AND (part_ = 0 OR (way % {facades.ACCENT} = 0 AND high + {facades.ACCENT_TO} < height))),
w AS (SELECT id, part, n, CASE part_ WHEN 0 THEN 'window' ELSE 'accent' END AS kind, ring, edge, floor, bay, ax + dx * (bay + 1) // (bays + 1) AS mx, ay + dy * (bay + 1) // (bays + 1) AS my, az + dz * (bay + 1) // (bays + 1) AS z, dx * half // len AS hx, dy * half // len AS hy,
  CASE part_ WHEN 0 THEN low + {facades.LIFT} ELSE high + {facades.ACCENT_FROM} END AS low, CASE part_ WHEN 0 THEN high + {facades.LIFT} ELSE high + {facades.ACCENT_TO} END AS high, CASE part_ WHEN 0 THEN [{FACADE.windows[0]}, {FACADE.windows[1]}][(way % 2)::INT + 1] ELSE {FACADE.accent} END AS v FROM q WHERE n < {facades.QUADS}),
d AS (SELECT *, {_VARY('id', 3)} + 1 AS share FROM (SELECT *, row_number() OVER (PARTITION BY id, part ORDER BY len DESC, edge DESC) AS best FROM e0 WHERE ring = 0) WHERE best = 1 AND len >= {FACADE.door[0] * 2}),
a AS (SELECT * FROM w UNION ALL SELECT id, part, (SELECT count(*) FROM w WHERE w.id = d.id AND w.part = d.part), 'door', 0, edge, 0, 0, ax + dx * share // 4, ay + dy * share // 4, az + dz * share // 4, dx * {FACADE.door[0] // 2} // len, dy * {FACADE.door[0] // 2} // len, {facades.DOOR_SILL}, least({FACADE.door[1]}, height - {facades.DOOR_FREE}), {FACADE.door_colour} FROM d)
SELECT id, part::INT AS part, n::BIGINT AS n, kind, ring::INT AS ring, edge::INT AS edge, floor::INT AS floor, bay::INT AS bay, (mx - hx)::BIGINT AS x0, (my - hy)::BIGINT AS y0, (mx + hx)::BIGINT AS x1, (my + hy)::BIGINT AS y1, z::BIGINT AS z, low::BIGINT AS low, high::BIGINT AS high, v::INT AS v FROM a""")
def openings(spark, sf) -> DataFrame:
    parts = world(spark, sf).where("class = 'building'").select("id", "height", F.posexplode("parts").alias("part", "rings"))
    return facades.facades(parts, FACADE)


#: Templates of landmarks: a tower with a cap, and a hall with a gate.
TEMPLATES = [
    ("tower", 0, "prism", 0, 0, 4000, 4000, 0, 9000, 5, 6), ("tower", 1, "prism", 0, 0, 2500, 2500, 9000, 30000, 5, 6), ("tower", 2, "pyramid", 0, 0, 2500, 2500, 30000, 36000, 7, 18),
    ("hall", 0, "prism", -1000, 500, 6000, 9000, 0, 7000, 6, 19), ("hall", 1, "panel", -1000, -8550, 1500, 0, 1000, 4000, 15, 15), ("hall", 2, "dome", 0, 0, 1, 1, 0, 1, 1, 1),
]
_T = ["template", "part", "kind", "u", "v", "half_u", "half_v", "low", "high", "wall", "roof"]
_P = lambda c, z: f"{{'x': x + (ux * (u + half_u * {c[0]}) + vx * (v + hv * {c[1]})) // 1000, 'y': y + (uy * (u + half_u * {c[0]}) + vy * (v + hv * {c[1]})) // 1000, 'z': z + {z}}}"
_L = [_P(c, "low") for c in landmarks.CORNERS]
_H = [_P(c, "high") for c in landmarks.CORNERS]
_F = lambda a, b, c, v: f"{{'a': {a}, 'b': {b}, 'c': {c}, 'v': {v}}}"
_W = lambda i: [_F(_L[i], _L[i + 1], _H[i + 1], "wall"), _F(_L[i], _H[i + 1], _H[i], "wall")]
_PRISM = ", ".join([f for i in range(4) for f in _W(i)] + [_F(_H[0], _H[1], _H[2], "roof"), _F(_H[0], _H[2], _H[3], "roof")])


@query("sg9_sf41_hp13_landmarks", f"""WITH t AS (SELECT * FROM (VALUES {', '.join(map(str, TEMPLATES))}) t({', '.join(_T)})), a AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'tower' WHEN 1 THEN 'hall' ELSE 'gone' END AS template, p_partkey * 7919 % 600000 AS x, p_partkey * 50021 % 600000 AS y, p_partkey % 5 * 100 AS z, p_size * 17 - 300 AS ux, 900 AS uy, -900 AS vx, p_size * 17 - 300 AS vy FROM part),
m AS (SELECT *, CASE kind WHEN 'panel' THEN 0 ELSE half_v END AS hv FROM a JOIN t USING (template)),
f AS (SELECT id, part, unnest(CASE kind WHEN 'prism' THEN [{_PRISM}] WHEN 'pyramid' THEN [{', '.join(_F(_L[i], _L[i + 1], _P((0, 0), 'high'), 'roof') for i in range(4))}] ELSE [{', '.join(_W(0))}] END) AS f, generate_subscripts(CASE kind WHEN 'prism' THEN range(10) WHEN 'pyramid' THEN range(4) ELSE range(2) END, 1) AS i FROM m WHERE kind <> 'dome')
SELECT id, part::INT AS part, row_number() OVER (PARTITION BY id ORDER BY part, i) - 1 AS face, f.a.x::BIGINT AS ax, f.a.y::BIGINT AS ay, f.a.z::BIGINT AS az, f.b.x::BIGINT AS bx, f.b.y::BIGINT AS by_, f.b.z::BIGINT AS bz, f.c.x::BIGINT AS cx, f.c.y::BIGINT AS cy, f.c.z::BIGINT AS cz, f.v::BIGINT AS v FROM f""")
def landmark_faces(spark, sf) -> DataFrame:
    kinds = ", ".join(f"{c} {'string' if c in ('template', 'kind') else 'int' if c == 'part' else 'bigint'}" for c in _T)
    templates = spark.createDataFrame(TEMPLATES, kinds)
    k, turn = F.col("p_partkey"), F.col("p_size").cast("bigint") * 17 - 300
    template = F.when(k % 3 == 0, "tower").when(k % 3 == 1, "hall").otherwise("gone")
    axes = {"ux": turn, "uy": F.lit(900).cast("bigint"), "vx": F.lit(-900).cast("bigint"), "vy": turn}
    anchors = table(spark, sf, "part").select(k.alias("id"), template.alias("template"), (k * 7919 % 600000).alias("x"), (k * 50021 % 600000).alias("y"), (k % 5 * 100).alias("z"), *[v.alias(c) for c, v in axes.items()])
    corners = [F.col(f"{p}.{c}").alias("by_" if p + c == "by" else p + c) for p in "abc" for c in "xyz"]
    return landmarks.set_up(anchors, templates).select("id", "part", "face", *corners, "v")
