"""Queries of raster kernels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.operators import kernels as k
from loamgrid.operators import watershed
from loamgrid.plans.inputs import RASTERS_SQL, rasters
from loamgrid.plans.registry import query

#: Coverage and colours of pixels: expressions that hold in both engines.
_COVERED = "(x * 7 + y * 13) % 29 <> 0"
_RGB = {"r": "(v * 7 + x) % 256", "g": "(v * 3 + y) % 256", "b": "v % 256"}


def covered(spark, sf) -> DataFrame:
    return rasters(spark, sf).withColumn("covered", F.expr(_COVERED))


_NEAR = lambda cols, extra="": f"SELECT a.raster_id, a.y, a.x, {cols} FROM g a JOIN g b ON a.raster_id = b.raster_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 {extra}"
GRADIENT_SQL = f"""{RASTERS_SQL}, g AS (SELECT *, {_COVERED} AS covered FROM ras), n AS ({_NEAR("b.v * (b.x - a.x) * CASE WHEN b.y = a.y THEN 10 ELSE 3 END AS dx, b.v * (b.y - a.y) * CASE WHEN b.x = a.x THEN 10 ELSE 3 END AS dy", "AND b.covered")}),
s AS (SELECT raster_id, y, x, sum(dx)::BIGINT AS dx, sum(dy)::BIGINT AS dy FROM n GROUP BY raster_id, y, x HAVING count(*) = 9),
grad AS (SELECT g.raster_id, g.y, g.x, coalesce(abs(dx) + abs(dy), 0)::BIGINT AS magnitude, CASE WHEN dx IS NULL OR abs(dy) * 2 < abs(dx) THEN 'horizontal' WHEN abs(dx) * 2 < abs(dy) THEN 'vertical' WHEN sign(dx) = sign(dy) THEN 'down' ELSE 'up' END AS direction FROM g LEFT JOIN s USING (raster_id, y, x)),
off AS (SELECT * FROM (VALUES ('horizontal', 1, 0), ('vertical', 0, 1), ('down', 1, 1), ('up', 1, -1)) t(direction, ox, oy)),
ridged AS (SELECT a.raster_id, a.y, a.x, a.magnitude, a.direction, a.magnitude >= coalesce(p.magnitude, 0) AND a.magnitude >= coalesce(q.magnitude, 0) AS ridge FROM grad a JOIN off USING (direction)
  LEFT JOIN grad p ON p.raster_id = a.raster_id AND p.x = a.x + ox AND p.y = a.y + oy LEFT JOIN grad q ON q.raster_id = a.raster_id AND q.x = a.x - ox AND q.y = a.y - oy)"""


@query("rk1_sf29_gradient", f"WITH {GRADIENT_SQL} SELECT * FROM grad")
def gradient(spark, sf) -> DataFrame:
    return k.gradient(covered(spark, sf))


@query("wn7_ridges", f"WITH {GRADIENT_SQL} SELECT raster_id, y, x, ridge FROM ridged")
def ridges(spark, sf) -> DataFrame:
    return k.ridges(k.gradient(covered(spark, sf))).select("raster_id", "y", "x", "ridge")


@query("rk2_normal_steps", f"""WITH {RASTERS_SQL}, g AS (SELECT raster_id, y, x, {_COVERED} AS covered, {', '.join(f'{e} AS {c}' for c, e in _RGB.items())} FROM ras), n AS ({_NEAR("(a.r - b.r) * (a.r - b.r) + (a.g - b.g) * (a.g - b.g) + (a.b - b.b) * (a.b - b.b) AS d", "AND a.covered AND b.covered")})
SELECT g.raster_id, g.y, g.x, coalesce(max(d), 0)::BIGINT AS step FROM g LEFT JOIN n USING (raster_id, y, x) GROUP BY g.raster_id, g.y, g.x""")
def normal_steps(spark, sf) -> DataFrame:
    return k.normal_steps(covered(spark, sf).withColumns({c: F.expr(e) for c, e in _RGB.items()}))


LOW, HIGH = 3000, 9000


@query("rk3_hysteresis", f"""WITH RECURSIVE {GRADIENT_SQL}, kept AS (SELECT * FROM ridged WHERE ridge AND magnitude >= {LOW}),
flood AS (SELECT raster_id, y, x FROM kept WHERE magnitude >= {HIGH} UNION SELECT n.raster_id, n.y, n.x FROM flood f JOIN kept n ON n.raster_id = f.raster_id AND abs(n.x - f.x) <= 1 AND abs(n.y - f.y) <= 1)
SELECT raster_id, y, x, CASE WHEN (raster_id, y, x) IN (SELECT (raster_id, y, x) FROM flood) THEN 255 ELSE 0 END::BIGINT AS "on" FROM ras""")
def hysteresis(spark, sf) -> DataFrame:
    return k.hysteresis(k.gradient(covered(spark, sf)), LOW, HIGH)


#: Components of bright pixels, by least row-order number of a pixel that is reached.
COMPONENTS_SQL = f"""{RASTERS_SQL}, lit AS (SELECT raster_id, y, x, y * 64 + x AS i FROM ras WHERE v > 1100),
lab(raster_id, y, x, label) USING KEY (raster_id, y, x) AS (SELECT raster_id, y, x, i FROM lit UNION
  SELECT r.raster_id, r.y, r.x, min(n.label) FROM recurring.lab r JOIN lab n ON r.raster_id = n.raster_id AND abs(r.x - n.x) <= 1 AND abs(r.y - n.y) <= 1 GROUP BY r.raster_id, r.y, r.x, r.label HAVING min(n.label) < r.label),
ranked AS (SELECT raster_id, y, x, dense_rank() OVER (PARTITION BY raster_id ORDER BY label) AS label FROM lab)"""


@query("rk7_wn9_components", f"WITH RECURSIVE {COMPONENTS_SQL} SELECT * FROM ranked")
def components(spark, sf) -> DataFrame:
    return k.labelled_pixels(k.labelled_runs(rasters(spark, sf).where("v > 1100").select("raster_id", "y", "x")))


@query("ag19_component_table", f"WITH RECURSIVE {COMPONENTS_SQL} SELECT raster_id, label, count(*) AS area, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM ranked GROUP BY raster_id, label")
def component_table(spark, sf) -> DataFrame:
    return k.component_table(k.labelled_runs(rasters(spark, sf).where("v > 1100").select("raster_id", "y", "x"))).drop("comp")


@query("rk8_chamfer", f"""WITH {RASTERS_SQL}, s AS (SELECT raster_id, y, x FROM ras WHERE v > 1200)
SELECT r.raster_id, r.y, r.x, coalesce(min(3 * greatest(abs(r.x - s.x), abs(r.y - s.y)) + least(abs(r.x - s.x), abs(r.y - s.y))), 1073741823)::BIGINT AS distance FROM ras r LEFT JOIN s ON r.raster_id = s.raster_id GROUP BY r.raster_id, r.y, r.x""")
def chamfer(spark, sf) -> DataFrame:
    return k.chamfer(rasters(spark, sf).withColumn("on", F.when(F.col("v") > 1200, 255).otherwise(0)))


_MARKER = "CASE WHEN (x * 7 + y * 13) % 29 <> 0 AND (x * 31 + y * 17) % 193 = 0 THEN 1 + (x + y * 3) % 7 ELSE 0 END"


@query("rk9_watershed", f"""WITH RECURSIVE {RASTERS_SQL}, g AS (SELECT raster_id, y, x, v, {_MARKER} AS marker FROM ras WHERE {_COVERED}),
c(raster_id, y, x, v, marker, cost) USING KEY (raster_id, y, x) AS (SELECT raster_id, y, x, v, marker, CASE WHEN marker > 0 THEN v ELSE 4611686018427387904 END FROM g UNION
  SELECT r.raster_id, r.y, r.x, r.v, r.marker, greatest(min(n.cost), r.v) FROM recurring.c r JOIN c n ON r.raster_id = n.raster_id AND abs(r.x - n.x) <= 1 AND abs(r.y - n.y) <= 1 WHERE r.marker = 0 GROUP BY r.raster_id, r.y, r.x, r.v, r.marker, r.cost HAVING greatest(min(n.cost), r.v) < r.cost),
l(raster_id, y, x, v, marker, cost, label) USING KEY (raster_id, y, x) AS (SELECT raster_id, y, x, v, marker, cost, CASE WHEN marker > 0 THEN marker ELSE 1000 END FROM c UNION
  SELECT r.raster_id, r.y, r.x, r.v, r.marker, r.cost, min(n.label) FROM recurring.l r JOIN l n ON r.raster_id = n.raster_id AND abs(r.x - n.x) <= 1 AND abs(r.y - n.y) <= 1 AND greatest(n.cost, r.v) = r.cost WHERE r.marker = 0 GROUP BY r.raster_id, r.y, r.x, r.v, r.marker, r.cost, r.label HAVING min(n.label) < r.label)
SELECT r.raster_id, r.y, r.x, CASE WHEN label < 1000 THEN label ELSE 0 END::BIGINT AS label FROM ras r LEFT JOIN l USING (raster_id, y, x)""")
def watersheds(spark, sf) -> DataFrame:
    return watershed.watershed(covered(spark, sf).select("raster_id", "y", "x", "v", "covered", F.expr(f"CAST(CASE WHEN {_COVERED} THEN {_MARKER} ELSE 0 END AS BIGINT)").alias("marker")))
