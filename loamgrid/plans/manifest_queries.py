"""Queries of manifests, styles, releases and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.operators import manifests as m
from loamgrid.plans.inputs import BOXES_SQL, boxes, table
from loamgrid.plans.record_queries import OBJECTS_SQL, broken, objects
from loamgrid.plans.registry import query


def made(spark, sf, name: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf, name).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def sql_of(columns: dict[str, str], name: str, source: str) -> str:
    return f"{source} AS (SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {name})".replace("AS STRING", "AS VARCHAR")


NAMES = {"id": "p_partkey", "name": "CASE p_partkey % 7 WHEN 0 THEN 'a-1' WHEN 1 THEN 'A' WHEN 2 THEN '' WHEN 3 THEN repeat('x', 65) WHEN 4 THEN 'a/../b' WHEN 5 THEN concat('a', chr(7)) ELSE p_name END", "flags": "CAST(p_partkey * 37 % 700 AS INT)"}


@query("sf16_sf26_texts", f"WITH {sql_of(NAMES, 'part', 't')} SELECT id, regexp_full_match(name, '[a-z0-9-]{{1,64}}') AS identifier, trim(name) <> '' AND strlen(name) <= 96 AND name <> concat('a', chr(7)) AND name NOT LIKE '%../%' AS plain, flags < 256 AS known, (flags & 5) = 5 AS both FROM t")
def texts(spark, sf) -> DataFrame:
    t = made(spark, sf, "part", NAMES)
    return t.select("id", m.identifier(F.col("name"), 64).alias("identifier"), m.plain_text(F.col("name"), 96).alias("plain"), m.known_flags(F.col("flags")).alias("known"), m.contains_flags(F.col("flags"), 5).alias("both"))


MANIFESTS = {"id": "p_partkey", "core_px": "p_partkey * 7 % 4200", "guard_px": "p_partkey % 600", "mm_per_px": "250", "span_mm": "(p_partkey * 7 % 4200 + 2 * (p_partkey % 600)) * 250 + CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END", "coverage_bp": "9900 + p_partkey % 120"}


@query("vl12_manifests", f"WITH {sql_of(MANIFESTS, 'part', 't')} " + broken({"side": "core_px + 2 * guard_px BETWEEN 1 AND 4096", "guard": "guard_px <= 512", "span": "id % 9 <> 0", "coverage": "coverage_bp BETWEEN 9950 AND 10000", "layers": "id % 4 <> 0", "digests": "id % 5 <> 0"}, "id::VARCHAR", "t"))
def manifests(spark, sf) -> DataFrame:
    layer = lambda n, k: F.struct(F.lit(n).alias("name"), F.when(F.col("id") % k == 0, "x").otherwise(F.sha2(F.lit(n), 256)).alias("sha256"))
    both = F.when(F.col("id") % 4 == 0, F.array(layer("depth", 5), layer("color", 10**9))).otherwise(F.array(layer("color", 10**9), layer("depth", 5)))
    return m.reference_manifests(made(spark, sf, "part", MANIFESTS).withColumn("layers", both).withColumn("required", F.array(F.lit("color"), F.lit("depth"))))


PACKS = {"id": "p_partkey", "colours": "p_partkey % 140", "low_mm": "p_size", "high_mm": "p_partkey % 50"}


@query("vl15_styles", f"WITH {sql_of(PACKS, 'part', 't')} " + broken({"palette": "colours BETWEEN 1 AND 128", "index": "colours > 100 AND id % 120 < colours", "measures": "id % 30 > 0", "heights": "low_mm < high_mm"}, "id::VARCHAR", "t"))
def style_packs(spark, sf) -> DataFrame:
    packs = made(spark, sf, "part", PACKS).withColumn("indices", F.array(F.lit(0).cast("bigint"), F.lit(100).cast("bigint"), F.col("id") % 120)).withColumn("measures", F.array(F.lit(1).cast("bigint"), F.col("id") % 30))
    return m.styles(packs)


HEADERS = {"id": "p_partkey", "width": "p_partkey * 91 % 17000", "height": "p_size", "colours": "p_partkey % 131", "length": "p_partkey * 91 % 17000 * p_size + CASE WHEN p_partkey % 8 = 0 THEN 1 ELSE 0 END", "largest": "p_partkey % 97"}


@query("hp9_images", f"WITH {sql_of(HEADERS, 'part', 't')} " + broken({"side": "width BETWEEN 1 AND 16384 AND height >= 1", "palette": "colours BETWEEN 1 AND 128", "length": "id % 8 <> 0", "index": "largest < colours"}, "id::VARCHAR", "t"))
def images(spark, sf) -> DataFrame:
    return m.images(made(spark, sf, "part", HEADERS))


PIXELS = {"id": "p_partkey", "class": "p_partkey % 26", "confidence": "p_size * 6", "evidence": "CAST(p_partkey * 5 % 300 AS INT)", "instance": "p_partkey % 3"}


@query("vl10_mask_pixels", f"WITH {sql_of(PIXELS, 'part', 't')} " + broken({"class": "class < 24", "confidence": "confidence <= 255", "evidence": "evidence < 256", "instance": "instance = 0 OR class > 0"}, "id::VARCHAR", "t"))
def mask_pixels(spark, sf) -> DataFrame:
    return m.mask_pixels(made(spark, sf, "part", PIXELS), "id")


@query("vl10_mask_counts", f"WITH {sql_of(PIXELS, 'part', 't')}, o AS (SELECT class, count(*) AS observed FROM t GROUP BY class), s AS (SELECT i AS class, coalesce(observed, 0) + CASE WHEN i % 5 = 0 THEN 1 ELSE 0 END AS stated FROM range(30) r(i) LEFT JOIN o ON o.class = i WHERE i % 7 <> 1) SELECT coalesce(s.class, o.class) AS class, coalesce(stated, 0) AS stated, coalesce(observed, 0) AS observed FROM s FULL JOIN o ON s.class = o.class WHERE coalesce(stated, 0) <> coalesce(observed, 0)")
def mask_counts(spark, sf) -> DataFrame:
    pixels = made(spark, sf, "part", PIXELS)
    seen = pixels.groupBy("class").agg(F.count("*").alias("_n"))
    stated = spark.range(30).select(F.col("id").alias("class")).where("class % 7 <> 1").join(seen, "class", "left").select("class", (F.coalesce("_n", F.lit(0)) + F.when(F.col("class") % 5 == 0, 1).otherwise(0)).alias("stated"))
    return m.mask_counts(stated, pixels)


TILES = {"release_id": "p_partkey - p_partkey % 100", "position": "p_partkey % 100", "level": "CASE WHEN p_partkey % 60 = 9 THEN 0 ELSE p_partkey % 100 END", "row": "p_partkey % 4", "col": "p_partkey % 5", "width": "p_partkey % 520", "height": "p_size", "digest": "concat(md5(p_name), CASE WHEN p_partkey % 6 = 0 THEN '' ELSE md5('b') END)", "bytes": "p_partkey % 11"}


@query("vl11_releases", f"WITH {sql_of(TILES, 'part', 't')}, o AS (SELECT *, lag(level) OVER w AS l, lag(row) OVER w AS r, lag(col) OVER w AS c FROM t WINDOW w AS (PARTITION BY release_id ORDER BY position)) " + broken({"order": "l IS NULL OR (l, r, c) < (level, row, col)", "side": "width BETWEEN 1 AND 512 AND height BETWEEN 1 AND 512", "digest": "length(digest) = 64", "bytes": "bytes > 0"}, "concat(release_id, ':', position)", "o"))
def releases(spark, sf) -> DataFrame:
    return m.releases(made(spark, sf, "part", TILES))


@query("vl23_landmarks", f"WITH {OBJECTS_SQL}, w AS (SELECT DISTINCT world_id FROM obj), n AS (SELECT unnest(['red widget', 'small ring', 'no such thing']) AS name, unnest([1, 2, 3]) AS i), g AS (SELECT world_id, name, i FROM w, n EXCEPT SELECT world_id, obj.name, i FROM obj JOIN n ON obj.name = n.name) SELECT world_id, list(name ORDER BY i) AS missing FROM g GROUP BY world_id")
def landmarks(spark, sf) -> DataFrame:
    return m.landmarks(objects(spark, sf), ["red widget", "small ring", "no such thing"])


LOG = {"id": "event_id", "size": "1000 + event_id % 7", "offset": "CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 500 END", "status": "CASE event_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 206 WHEN 2 THEN 206 ELSE 416 END", "locked_etag": "CASE WHEN event_id % 5 = 0 THEN 'x' END", "etag": "CASE event_id % 10 WHEN 0 THEN 'x' WHEN 1 THEN 'y' END", "range": "CASE WHEN event_id % 6 = 1 THEN concat('bytes ', CAST(event_id % 500 AS STRING), '-', CAST(999 + event_id % 7 AS STRING), '/', CAST(1000 + event_id % 7 AS STRING)) END"}


@query("io6_responses", f"WITH {sql_of(LOG, 'events', 't')} SELECT * FROM (SELECT id, CASE WHEN locked_etag IS NOT NULL AND etag IS DISTINCT FROM locked_etag THEN 'etag' WHEN \"offset\" = 0 AND status <> 200 THEN 'status' WHEN \"offset\" > 0 AND status <> 206 THEN 'status' WHEN \"offset\" > 0 AND range IS NULL THEN 'range' END AS problem FROM t) WHERE problem IS NOT NULL".replace("END AS offset", 'END AS "offset"'))
def responses(spark, sf) -> DataFrame:
    return m.responses(made(spark, sf, "events", LOG))


RUNS = {"id": "o_custkey", "tiles": "o_orderkey % 300", "millis": "1 + o_orderkey % 90000", "rss_mb": "o_orderkey % 600"}


@query("ag22_gates", f"WITH {sql_of(RUNS, 'orders', 't')} SELECT id, min(tiles * 60000 // millis) AS rate, bool_and(tiles * 60000 // millis >= 100 AND millis <= 60000 AND rss_mb <= 512) AS passed FROM t GROUP BY id")
def gates(spark, sf) -> DataFrame:
    return m.gates(made(spark, sf, "orders", RUNS), 100, 60, 512)


RECORDS = {"lock_id": "p_partkey - p_partkey % 20", "id": "concat('s', lpad(CAST(p_partkey AS STRING), 6, '0'))", "cached": "p_partkey % 3 = 0", "bytes": "p_partkey * 10"}


@query("ag16_ag24_sync_report", f"WITH {sql_of(RECORDS, 'part', 't')} SELECT lock_id, count_if(cached) AS cached, count_if(NOT cached) AS fetched, sum(bytes)::BIGINT AS bytes, string_agg(concat(id, CASE WHEN cached THEN ' cached ' ELSE ' fetched ' END, bytes), chr(10) ORDER BY id) AS report FROM t GROUP BY lock_id")
def sync_report(spark, sf) -> DataFrame:
    return m.sync_report(made(spark, sf, "part", RECORDS))


@query("sf9_vertices", f"WITH {BOXES_SQL} SELECT id, (min_x - min_y) * 256 // 250 AS x, ((min_x + min_y) * 256 // 250) // 2 - height * 256 // 250 AS y, (min_x + min_y + height) * 16 + class AS depth FROM boxes")
def vertices(spark, sf) -> DataFrame:
    v = m.scene_vertex(F.col("min_x"), F.col("min_y"), F.col("height"), F.col("class"), 256, 250, 250)
    return boxes(spark, sf).withColumn("v", v).select("id", "v.*")


@query("ge7_projected_boxes", f"WITH {BOXES_SQL}, c AS (SELECT id, CASE WHEN i % 2 = 0 THEN min_x ELSE max_x END AS x, CASE WHEN i // 2 % 2 = 0 THEN min_y ELSE max_y END AS y, CASE WHEN i // 4 = 0 THEN min_z ELSE min_z + height END AS z FROM boxes, range(8) t(i)), p AS (SELECT id, (x - y) * 256 // 250 AS sx, ((x + y) * 256 // 250) // 2 - z * 256 // 250 AS sy FROM c) SELECT id, min(sx) AS min_x, min(sy) AS min_y, max(sx) AS max_x, max(sy) AS max_y FROM p GROUP BY id")
def projected_boxes(spark, sf) -> DataFrame:
    box = m.projected_box(*[F.col(c) for c in ("min_x", "min_y", "min_z", "max_x", "max_y")], F.col("min_z") + F.col("height"), 256, 250, 250)
    return boxes(spark, sf).withColumn("b", box).select("id", "b.*")


@query("so5_capped", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 5")
def capped(spark, sf) -> DataFrame:
    return m.capped(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], 5)


@query("se1_se4_appended", f"WITH {BOXES_SQL}, a AS (SELECT id, 'box' AS kind FROM boxes UNION ALL SELECT o_custkey, 'way' FROM orders UNION ALL SELECT id, 'box' FROM boxes) SELECT kind, count(*) AS n, count(DISTINCT id) AS ids FROM a GROUP BY kind")
def appended(spark, sf) -> DataFrame:
    one = boxes(spark, sf).select("id", F.lit("box").alias("kind"))
    every = one.unionByName(table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.lit("way").alias("kind"))).unionByName(one)
    return every.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))
