"""Queries of scene generators and patch records, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.operators import scene
from loamgrid.plans.geometry_queries import POINTS_SQL, rings
from loamgrid.plans.inputs import table
from loamgrid.plans.manifest_queries import made, sql_of
from loamgrid.plans.record_queries import broken
from loamgrid.plans.registry import query


@query("sg5_hip_roofs", f"""WITH {POINTS_SQL}, open AS (SELECT * FROM pts WHERE k < 8), t AS (SELECT a.id, sign((b.x - a.x)::HUGEINT * (c.y - a.y) - (b.y - a.y)::HUGEINT * (c.x - a.x)) AS s FROM open a JOIN open b ON a.id = b.id AND b.k = (a.k + 1) % 8 JOIN open c ON a.id = c.id AND c.k = (a.k + 2) % 8),
ok AS (SELECT id FROM t GROUP BY id HAVING NOT (bool_or(s > 0) AND bool_or(s < 0))), m AS (SELECT id, sum(x)::BIGINT // 8 AS x, sum(y)::BIGINT // 8 AS y FROM open GROUP BY id)
SELECT e.id, e.i, (e.i + e.id % 2) % 2 AS face, m.x, m.y, e.id % 50 * 300 + least(greatest((e.id % 50 * 300) // 3, 1500), 4000) AS z FROM edge e JOIN ok USING (id) JOIN m ON e.id = m.id""")
def hip_roofs(spark, sf) -> DataFrame:
    shapes = rings(spark, sf).withColumns({"height": F.col("id") % 50 * 300, "start": F.col("id") % 2})
    return scene.hip_roofs(shapes, 4000)


_U = lambda x, s, m: f"((xor(({x})::UBIGINT, ({x})::UBIGINT >> {s}))::UHUGEINT * {m} % 18446744073709551616)"
_BITS = lambda x: f"((({x})::HUGEINT + 18446744073709551616) % 18446744073709551616)"
_ROTATE = lambda x, k: f"(({x})::UHUGEINT * {2**k} % 18446744073709551616 + ({x})::UHUGEINT // {2 ** (64 - k)})"


@query("sg6_tree_centres", f"""WITH {POINTS_SQL}, box AS (SELECT id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts GROUP BY id), f AS (SELECT *, (x0 - ((x0 % 900) + 900) % 900) AS fx, (y0 - ((y0 % 900) + 900) % 900) AS fy FROM box),
g AS (SELECT id, fx + a * 900 AS gx, fy + b * 900 AS gy FROM f, range(40) s(a), range(40) t(b) WHERE fx + a * 900 <= x1 AND fy + b * 900 <= y1),
s AS (SELECT *, xor(xor(id::UBIGINT, {_ROTATE(_BITS("gx"), 17)}::UBIGINT), {_BITS("gy")}::UBIGINT) AS s FROM g), c AS (SELECT *, {_U(_U("s", 30, 13787848793156543929), 27, 10723151780598845931)} AS m FROM s), h AS (SELECT *, xor(m::UBIGINT, m::UBIGINT >> 31) AS h FROM c),
p AS (SELECT id, gx + (h % 361)::BIGINT - 180 AS px, gy + ({_ROTATE("h", 29)} % 361)::BIGINT - 180 AS py FROM h),
e AS (SELECT p.id, px, py, ay, uy, (ux - ax)::HUGEINT * (py - ay) - (uy - ay)::HUGEINT * (px - ax) AS side FROM p JOIN edge d ON p.id = d.id)
SELECT id, px AS x, py AS y FROM e GROUP BY id, px, py HAVING sum(CASE WHEN (ay > py) <> (uy > py) AND (CASE WHEN uy > ay THEN side > 0 ELSE side < 0 END) THEN 1 ELSE 0 END) % 2 = 1""")
def tree_centres(spark, sf) -> DataFrame:
    return scene.tree_centres(rings(spark, sf).select("id", F.array("ring").alias("rings")), 900).drop("n")


PATCHES = {"id": "p_partkey", "patch_id": "CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END", "west": "p_partkey % 400 - 200", "east": "p_partkey % 370 - 150", "south": "p_partkey % 200 - 100", "north": "p_size", "sha256": "concat(md5(p_name), CASE WHEN p_partkey % 6 = 0 THEN 'G' ELSE md5('b') END)", "license": "CASE WHEN p_partkey % 5 > 0 THEN 'CC0' END", "kind": "CASE p_partkey % 4 WHEN 0 THEN 'car' WHEN 1 THEN 'tree' ELSE 'water' END"}


@query("vl21_ge12_patches", f"WITH {sql_of(PATCHES, 'part', 't')} " + broken({"longitude": "west >= -180 AND west < east AND east <= 180", "latitude": "south >= -90 AND south < north AND north <= 90", "identity": "patch_id <> '' AND id % 7 <> 0", "classes": "kind <> 'car'", "digest": "length(sha256) = 64", "license": "license IS NOT NULL"}, "id::VARCHAR", "t"))
def patches(spark, sf) -> DataFrame:
    records = made(spark, sf, "part", PATCHES).withColumn("classes", F.array(F.lit("water"), F.col("kind")))
    return scene.patches(records.withColumn("source_record_ids", F.array_repeat(F.lit("s"), (F.col("id") % 7).cast("int"))), ["water", "tree"])


@query("sf28_codes", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 END::BIGINT AS code, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN p_type END AS decoded FROM part")
def codes(spark, sf) -> DataFrame:
    return scene.codes(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", ["ECONOMY", "STANDARD"]).drop("p_type")
