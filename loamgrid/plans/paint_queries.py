"""Queries of images and primitives, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.functions import intmath
from loamgrid.operators import paint
from loamgrid.plans.geometry_queries import POINTS_SQL, rings
from loamgrid.plans.inputs import RASTERS_SQL, rasters, table
from loamgrid.plans.registry import query

W, H = 64, 48
TRIANGLES = {
    "image_id": "p_partkey - p_partkey % 50", "key": "CASE WHEN p_partkey % 45 = 3 THEN 0 WHEN p_partkey % 45 = 5 THEN p_partkey - 1 ELSE p_partkey END", "v": "p_partkey % 17",
    "x0": "p_partkey * 7919 % 70 * 256 - 700 + p_partkey % 3 * 128", "y0": "p_partkey * 104729 % 52 * 256 - 500 + p_partkey % 5 * 64", "d0": "p_partkey * 31 % 900 - 300",
    "x1": "p_partkey * 6151 % 70 * 256 - 700 + p_partkey % 2 * 128", "y1": "p_partkey * 3079 % 52 * 256 - 500", "d1": "p_partkey * 37 % 900 - 300",
    "x2": "CASE WHEN p_partkey % 33 = 1 THEN p_partkey * 6151 % 70 * 256 - 700 + p_partkey % 2 * 128 ELSE p_partkey * 50021 % 70 * 256 - 700 END", "y2": "CASE WHEN p_partkey % 33 = 1 THEN p_partkey * 3079 % 52 * 256 - 500 ELSE p_partkey * 1299709 % 52 * 256 - 500 END", "d2": "p_partkey * 41 % 900 - 300",
}
TRIANGLES_SQL = f"tri AS (SELECT {', '.join(f'{e} AS {n}' for n, e in TRIANGLES.items())} FROM part)"
_EDGE = lambda a, b, x, y: f"((x{b} - x{a})::HUGEINT * ({y} - y{a}) - (y{b} - y{a})::HUGEINT * ({x} - x{a}))"


def triangles(spark, sf) -> DataFrame:
    return table(spark, sf, "part").selectExpr(*[f"{e} AS {n}" for n, e in TRIANGLES.items()])


@query("vl17_triangles", f"""WITH {TRIANGLES_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY image_id, key) AS n FROM tri) SELECT * FROM (SELECT concat(image_id, ':', key) AS key, unnest([CASE WHEN key = 0 OR n > 1 THEN 'key' END, CASE WHEN v > 15 THEN 'palette' END, CASE WHEN {_EDGE(0, 1, 'x2', 'y2')} = 0 THEN 'area' END]) AS check_id FROM c) WHERE check_id IS NOT NULL""")
def triangle_rules(spark, sf) -> DataFrame:
    return paint.triangle_rules(triangles(spark, sf), 16)


_HOLDS = lambda w, a, b: f"(w{w} > 0 OR (w{w} = 0 AND (y{a} < y{b} OR (y{a} = y{b} AND x{a} < x{b}))))"


@query("rk17_jn13_raster", f"""WITH {TRIANGLES_SQL}, a AS (SELECT *, {_EDGE(0, 1, 'x2', 'y2')} AS area0 FROM tri WHERE p_ok), tri2 AS (SELECT image_id, key, v, x0, y0, d0, CASE WHEN area0 < 0 THEN x2 ELSE x1 END AS x1, CASE WHEN area0 < 0 THEN y2 ELSE y1 END AS y1, CASE WHEN area0 < 0 THEN d2 ELSE d1 END AS d1,
  CASE WHEN area0 < 0 THEN x1 ELSE x2 END AS x2, CASE WHEN area0 < 0 THEN y1 ELSE y2 END AS y2, CASE WHEN area0 < 0 THEN d1 ELSE d2 END AS d2, abs(area0) AS area FROM a WHERE area0 <> 0),
p AS (SELECT t.*, x.x AS x, y.y AS y, {_EDGE(1, 2, 'x.x * 256 + 128', 'y.y * 256 + 128')} AS w0, {_EDGE(2, 0, 'x.x * 256 + 128', 'y.y * 256 + 128')} AS w1, {_EDGE(0, 1, 'x.x * 256 + 128', 'y.y * 256 + 128')} AS w2 FROM tri2 t, range({W}) x(x), range({H}) y(y)),
i AS (SELECT image_id, y, x, v, key, (w0 * d0 + w1 * d1 + w2 * d2) // area AS depth FROM p WHERE {_HOLDS(0, 1, 2)} AND {_HOLDS(1, 2, 0)} AND {_HOLDS(2, 0, 1)})
SELECT image_id, y, x, arg_max(v, (depth, -key)) AS v FROM i GROUP BY image_id, y, x""".replace(" WHERE p_ok", ""))
def raster(spark, sf) -> DataFrame:
    each = table(spark, sf, "part").selectExpr("p_partkey", *[f"{e} AS {n}" for n, e in TRIANGLES.items()])
    return paint.drawn(each, W, H, "p_partkey")  # some share a key: the one that comes first is seen


OBJECTS = {"image_id": "p_partkey - p_partkey % 40", "id": "p_partkey", "cx": "p_partkey * 7919 % 70", "cy": "p_partkey * 50021 % 50", "radius": "2 + p_size % 9", "height": "CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size % 12 END"}
_NAMES = list(paint.COLOURS)
OBJECTS_SQL = f"o AS (SELECT {', '.join(f'{e} AS {n}' for n, e in OBJECTS.items())}, [{', '.join(map(str, paint.COLOURS.values()))}][p_partkey % 9 + 1] + CASE WHEN p_partkey % 9 IN (0, 7) THEN p_partkey % 2 ELSE 0 END AS v FROM part)"


def objects(spark, sf) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("p_partkey") % 9 + 1).cast("int"))
    return table(spark, sf, "part").select(*[F.expr(f"CAST({e} AS BIGINT)").alias(n) for n, e in OBJECTS.items()], paint.semantic_colour(name, F.col("p_partkey") % 2).alias("v"))


@query("rk18_sf30_painted", f"""WITH {OBJECTS_SQL}, s AS (SELECT image_id, id, 0 AS part, v, cy + y // 2 AS y, cx + x AS x FROM o, range(-11, 12) a(y), range(-11, 12) b(x) WHERE abs(y) + abs(x) <= radius
  UNION ALL SELECT image_id, id, 1, CASE WHEN x < 0 THEN least(v + 1, 15) ELSE v END, cy - y, cx + x FROM o, range(12) a(y), range(-11, 12) b(x) WHERE y < height AND abs(x) <= radius // 2)
SELECT image_id, y, x, arg_max(v, (id, part))::BIGINT AS v FROM s WHERE x BETWEEN 0 AND {W - 1} AND y BETWEEN 0 AND {H - 1} GROUP BY image_id, y, x""")
def painted(spark, sf) -> DataFrame:
    return paint.painted(objects(spark, sf), W, H)


#: Images of 64 pixels a side (the last one may have fewer rows), with 16 colours, from the rasters.
IMAGE_SQL = f"{RASTERS_SQL}, img AS (SELECT raster_id AS image_id, y, x, v % 16 AS v FROM ras)"


def image(spark, sf) -> DataFrame:
    return rasters(spark, sf).select(F.col("raster_id").alias("image_id"), "y", "x", (F.col("v") % 16).alias("v"))


@query("jn11_shadows", f"WITH {IMAGE_SQL} SELECT image_id, y, x, CASE WHEN (x * 3 + y * 5) % 4 = 0 AND v IN (1, 2, 4, 9, 12, 14) THEN 3 ELSE v END AS v FROM img")
def shadows(spark, sf) -> DataFrame:
    return paint.shaded(image(spark, sf), image(spark, sf).where("(x * 3 + y * 5) % 4 = 0"), [1, 2, 4, 9, 12, 14], 3)


@query("wn6_outlines", f"""WITH {IMAGE_SQL}, f AS (SELECT *, CASE WHEN v IN (5, 6, 7) THEN 1 WHEN v IN (2, 3) THEN 2 ELSE 0 END AS f FROM img), n AS (SELECT a.image_id, a.y, a.x, bool_or(a.f <> b.f) AS other FROM f a JOIN f b ON a.image_id = b.image_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY ALL)
SELECT f.image_id, f.y, f.x, CASE WHEN f <> 0 AND other AND f.x BETWEEN 1 AND 62 AND f.y BETWEEN 1 AND 62 THEN 13 ELSE v END AS v FROM f JOIN n ON f.image_id = n.image_id AND f.y = n.y AND f.x = n.x""")
def outlines(spark, sf) -> DataFrame:
    return paint.outlined(image(spark, sf), {5: 1, 6: 1, 7: 1, 2: 2, 3: 2}, 13, 64, 64)


STYLE = {"subpixels": 256, "roofs": [5, 6], "roof_pattern": 20, "roof_period": 3, "road": 9, "marking": 21, "way_period": 5, "path": 8, "highlight": 22, "terrain": ((1, 2), 3), "athletic": ((12, 13), 4), "parking": ((10, 11), 4)}
_U = lambda x, s, m: f"((xor(({x})::UBIGINT, ({x})::UBIGINT >> {s}))::UHUGEINT * {m} % 18446744073709551616)"
_ROT = "((((ax::HUGEINT + 18446744073709551616) % 18446744073709551616)::UHUGEINT * 8192 % 18446744073709551616) + (((ax::HUGEINT + 18446744073709551616) % 18446744073709551616)::UHUGEINT // 2251799813685248))"
_MOD = lambda a, n: f"((({a}) % {n} + {n}) % {n})"


@query("rk14_patterns", f"""WITH {IMAGE_SQL}, a AS (SELECT *, x * 256 + 7000 AS ax, y * 256 - 3000 AS ay, (x * 256 + 7000) // 256 AS lx, (y * 256 - 3000 - {_MOD('y * 256 - 3000', 256)}) // 256 AS ly FROM img),
b AS (SELECT *, xor({_ROT}::UBIGINT, ((ay::HUGEINT + 18446744073709551616) % 18446744073709551616)::UBIGINT) AS s FROM a), c AS (SELECT *, {_U(_U("s", 30, 13787848793156543929), 27, 10723151780598845931)} AS m FROM b), d AS (SELECT *, xor(m::UBIGINT, m::UBIGINT >> 31) AS h FROM c)
SELECT image_id, y, x, CASE WHEN v IN (5, 6) AND {_MOD('lx - ly', 3)} = 0 AND {_MOD('lx + ly', 4)} < 2 THEN 20 WHEN v = 9 AND {_MOD('lx + ly', 10)} = 0 AND {_MOD('lx - ly', 8)} < 4 THEN 21 WHEN v = 8 AND {_MOD('lx - ly', 5)} = 0 AND {_MOD('lx + ly', 6)} < 2 THEN 22
  WHEN v = 1 AND h % 3 = 0 THEN 2 WHEN v = 12 AND h % 4 = 0 THEN 13 WHEN v = 10 AND {_MOD('lx + ly', 4)} = 0 THEN 11 ELSE v END AS v FROM d""")
def patterns(spark, sf) -> DataFrame:
    return paint.patterned(image(spark, sf), STYLE, -7000, 3000)


@query("rk16_jn15_masks", f"WITH {IMAGE_SQL} SELECT image_id, y, x, CASE WHEN v IN (1, 2, 3) THEN 0 ELSE 13 END AS v, CASE WHEN v NOT IN (1, 2, 3) THEN '00000d' ELSE '000000' END AS rgb FROM img WHERE TRUE")
def landmark_masks(spark, sf) -> DataFrame:
    palette = spark.range(14).select(F.col("id").cast("int").alias("v"), F.format_string("%06x", "id").alias("rgb"))
    return paint.coloured(paint.masked(image(spark, sf), [1, 2, 3], 13), palette)


@query("ag17_colour_changes", f"""WITH {IMAGE_SQL}, p AS (SELECT a.image_id, a.v <> b.v AS c FROM img a JOIN img b ON a.image_id = b.image_id AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.y = a.y + 1 AND b.x = a.x)))
SELECT image_id, (SELECT count(DISTINCT v) FROM img i WHERE i.image_id = p.image_id) AS colours, count_if(c)::BIGINT * 1000000 // count(*) AS changes_ppm FROM p GROUP BY image_id""")
def colour_changes(spark, sf) -> DataFrame:
    return paint.colour_changes(image(spark, sf))


@query("ag18_core_coverage", f"WITH {IMAGE_SQL} SELECT image_id, count_if(v * 16 >= 128)::BIGINT * 10000 // 600 AS coverage_bp FROM img WHERE x BETWEEN 5 AND 34 AND y BETWEEN 5 AND 24 GROUP BY image_id")
def core_coverage(spark, sf) -> DataFrame:
    return paint.core_coverage(image(spark, sf).withColumn("v", F.col("v") * 16), 5, 30, 20)


@query("ag21_sf42_tones", f"WITH {IMAGE_SQL}, r AS (SELECT image_id, min(v) FILTER (v > 0) AS lo, max(v) AS hi FROM img GROUP BY image_id) SELECT image_id, y, x, CASE WHEN v > 0 THEN 255 - floor((v - lo) * 220.0::DOUBLE / (hi - lo) + 0.5) ELSE 0 END::BIGINT AS tone FROM img JOIN r USING (image_id)")
def tones(spark, sf) -> DataFrame:
    return paint.depth_tones(image(spark, sf))


_KEY = lambda i, p, o: f"xor(xor(({i})::UBIGINT, (({p})::UHUGEINT * 11400714819323198485 % 18446744073709551616)::UBIGINT), (({o})::UHUGEINT * 13787848793156543929 % 18446744073709551616)::UBIGINT)"


@query("sf13_primitive_keys", f"""SELECT event_id, xor(c::UBIGINT, c::UBIGINT >> 31)::VARCHAR AS key FROM (SELECT event_id, {_U(_U(_KEY("event_id", "event_id % 8 + 1", "event_id % 500"), 30, 13787848793156543929), 27, 10723151780598845931)} AS c FROM events)""")
def primitive_keys(spark, sf) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", intmath.primitive_key(e, e % 8 + 1, e % 500).cast("string").alias("key"))


@query("sf14_facade_variants", f"""SELECT event_id, xor(c::UBIGINT, c::UBIGINT >> 31)::VARCHAR AS variant FROM (SELECT event_id, {_U(_U("xor(xor(xor(xor(event_id::UBIGINT, (event_id % 3)::UBIGINT << 11), (event_id % 40)::UBIGINT << 23), (event_id % 9)::UBIGINT << 37), (event_id % 17)::UBIGINT << 49)", 30, 13787848793156543929), 27, 10723151780598845931)} AS c FROM events)""")
def facade_variants(spark, sf) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", intmath.facade_variant(e, e % 3, e % 40, e % 9, e % 17).cast("string").alias("variant"))


@query("sg2_wn12_walls", f"""WITH {POINTS_SQL}, e AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS n FROM edge WHERE ax <> ux OR ay <> uy) SELECT id, n * 2 + part AS ordinal, ux - ax >= uy - ay AS light, ax AS x0, CASE WHEN part = 0 THEN ux ELSE ax END AS x2, id % 50 * 300 AS z2 FROM e, range(2) t(part)""")
def walls(spark, sf) -> DataFrame:
    t = paint.walls(rings(spark, sf).withColumn("height", F.col("id") % 50 * 300))
    return t.select("id", "ordinal", "light", F.col("a.x").alias("x0"), F.col("c.x").alias("x2"), F.col("c.z").alias("z2"))


@query("sg8_shadow_rings", f"WITH {POINTS_SQL} SELECT id, min(x + id % 50 * 300 * 350 // 1000) AS min_x, max(y - id % 50 * 300 * 200 // 1000) AS max_y FROM pts GROUP BY id")
def shadow_rings(spark, sf) -> DataFrame:
    s = paint.shifted(rings(spark, sf).withColumn("h", F.col("id") % 50 * 300), "h", 350, -200)
    return s.select("id", F.array_min(F.transform("shadow", lambda p: p["x"])).alias("min_x"), F.array_max(F.transform("shadow", lambda p: p["y"])).alias("max_y"))
