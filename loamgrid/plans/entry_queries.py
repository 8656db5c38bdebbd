"""Queries of registrations, layer contracts, options, viewports and messages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.operators import entries
from loamgrid.plans.inputs import BOXES_SQL, boxes, table
from loamgrid.plans.manifest_queries import made, sql_of
from loamgrid.plans.record_queries import broken
from loamgrid.plans.registry import query

_KINDS = [*entries.LAYERS, "normals"]
LAYER = {
    "bundle": "p_partkey", "k": f"p_partkey % {len(_KINDS)}", "kind": "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END",
    "path": "CASE WHEN p_partkey % 5 = 0 THEN 'color.png' ELSE CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{v[0]}'" for i, v in enumerate(entries.LAYERS.values())) + " ELSE 'x' END END",
    "encoding": "CASE WHEN p_partkey % 4 = 0 THEN 'png-gray8' ELSE CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{v[1]}'" for i, v in enumerate(entries.LAYERS.values())) + " ELSE 'x' END END",
    "width": "p_size + 64", "height": "CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE p_size + 32 END", "total_width": "p_size + 64", "total_height": "p_size + 32",
}
_FILE = lambda i: "CASE p_partkey_ % 7 " + " ".join(f"WHEN {j} THEN '{v[i]}'" for j, v in enumerate(entries.LAYERS.values())) + " END"


@query("hp16_layer_contracts", f"WITH {sql_of(LAYER, 'part', 't0')}, t AS (SELECT *, bundle AS p_partkey_ FROM t0) " + broken({"kind": "kind <> 'normals'", "path": f"coalesce(path = {_FILE(0)}, FALSE)", "encoding": f"coalesce(encoding = {_FILE(1)}, FALSE)", "grid": "width = total_width AND height = total_height"}, "concat(bundle, ':', kind)", "t"))
def layer_contracts(spark, sf) -> DataFrame:
    return entries.layer_rules(made(spark, sf, "part", LAYER))


MANIFEST = {"bundle_id": "concat('b', p_partkey)", "region_id": "p_brand", "core_width": "p_size * 8", "core_height": "p_size * 6", "guard": "p_partkey % 9 + 1", "grid_json": "concat('[', p_size, ',', p_partkey % 9, ']')", "manifest_json": "concat('{', p_name, '}')"}


@query("hp1_registrations", f"WITH {sql_of(MANIFEST, 'part', 't')} SELECT bundle_id, sha256(manifest_json) AS manifest_sha256, region_id, (core_width + 2 * guard)::BIGINT AS width_px, (core_height + 2 * guard)::BIGINT AS height_px, sha256(grid_json) AS grid_sha256 FROM t")
def registrations(spark, sf) -> DataFrame:
    r = entries.registrations(made(spark, sf, "part", MANIFEST))
    return r.withColumns({c: F.col(c).cast("bigint") for c in ("width_px", "height_px")})


OPTIONS = {"id": "o_orderkey", "world_sha256": "CASE WHEN o_orderkey % 6 = 0 THEN 'ABC' ELSE concat(md5(o_orderpriority), md5('w')) END", "style_sha256": "CASE WHEN o_orderkey % 10 = 0 THEN upper(concat(md5(o_orderpriority), md5('s'))) ELSE concat(md5(o_orderpriority), md5('s')) END", "tile_size": "CASE WHEN o_orderkey % 4 = 0 THEN 256 ELSE 512 END", "half_step": "CASE WHEN o_orderkey % 7 = 0 THEN 1000 ELSE 250 END"}


@query("hp8_publish_options", f"WITH {sql_of(OPTIONS, 'orders', 't')} " + broken({"world": "length(world_sha256) = 64", "style": "regexp_full_match(style_sha256, '[0-9a-f]{64}')", "tile": "tile_size = 512", "scale": "half_step = 250"}, "id::VARCHAR", "t"))
def publish_options(spark, sf) -> DataFrame:
    return entries.publish_options(made(spark, sf, "orders", OPTIONS))


@query("hp12_ge10_viewports", f"WITH {BOXES_SQL} SELECT id, min_x * 3 - (id % 50) * 64 * 256 AS offset_x, min_y * 3 - (id % 30) * 64 * 256 AS offset_y, (max_x - min_x + 19999) // 20000 AS columns, (max_y - min_y + 19999) // 20000 AS rows FROM boxes")
def viewports(spark, sf) -> DataFrame:
    v = entries.viewport(F.col("min_x") * 3, F.col("min_y") * 3, F.col("id") % 50 * 64, F.col("id") % 30 * 64)
    size = entries.grid_size(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"))
    return boxes(spark, sf).withColumns({"v": v, "g": size}).select("id", "v.offset_x", "v.offset_y", "g.columns", "g.rows")


_X = lambda x, y: f"abs((({x}) - ({y})) * 256 // step)"
_Y = lambda x, y, z: f"abs(((({x}) + ({y})) * 256 // step) // 2 - ({z}) * 256 // rise)"
_POINTS = [("sx", "sy", "0"), ("r", "-r", "0"), ("-r", "r", "0"), ("r", "r", "h"), ("-r", "-r", "h")]


@query("ge11_style_guards", f"WITH s AS (SELECT p_partkey AS id, p_partkey % 40 * 100 AS sx, -(p_partkey % 33) * 150 AS sy, p_partkey % 30 * 100 + 1000 AS r, p_size::BIGINT * 250 AS h, 250 + p_partkey % 4 * 250 AS step, 300 + p_partkey % 3 * 100 AS rise FROM part) SELECT id, (greatest({', '.join(f'{_X(x, y)}, {_Y(x, y, z)}' for x, y, z in _POINTS)}) + 255) // 256 + 2 AS guard FROM s")
def style_guards(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    guard = entries.guard(k % 40 * 100, -(k % 33) * 150, k % 30 * 100, F.col("p_size").cast("bigint") * 250, 250 + k % 4 * 250, 300 + k % 3 * 100)
    return table(spark, sf, "part").select(k.alias("id"), guard.alias("guard"))


@query("hp15_failures", "SELECT page_id, format('source s{} failed at {} after {} attempts: {}', page_id % 90, CASE page_id % 3 WHEN 0 THEN 'http request' WHEN 1 THEN 'local source stream' ELSE 'digest' END, page_id % 3 + 1, CASE page_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'GET [address] refused' ELSE '[address]' END) AS message FROM pages")
def failures(spark, sf) -> DataFrame:
    k = F.col("page_id")
    stage = F.when(k % 3 == 0, "http request").when(k % 3 == 1, "local source stream").otherwise("digest")
    detail = F.when(k % 4 == 0, "timeout").when(k % 4 == 1, F.concat(F.lit("GET "), "url", F.lit("?key=abc refused"))).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", entries.failure_message(F.concat(F.lit("s"), (k % 90).cast("string")), stage, k % 3 + 1, detail).alias("message"))


@query("hp5_features", """SELECT p_partkey AS id, concat('{"id":', p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE ',"name":"n' || p_partkey || '"' END, ',"class":"building","height_mm":', p_size * 300, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ',"floor_count":' || p_size END, ',"confidence_bp":9000,"source_ids":["a","b"]', CASE WHEN p_partkey % 5 = 0 THEN ',"parent_id":' || (p_partkey // 5) ELSE '' END, '}') AS json FROM part""")
def features(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    return entries.features_json(table(spark, sf, "part").select(k.alias("id"), F.when(k % 4 != 0, F.concat(F.lit("n"), k.cast("string"))).alias("name"), F.lit("building").alias("class"), (F.col("p_size") * 300).alias("height_mm"), F.when(k % 3 != 0, F.col("p_size")).alias("floor_count"), F.lit(9000).alias("confidence_bp"), F.array(F.lit("a"), F.lit("b")).alias("source_ids"), F.when(k % 5 == 0, F.expr("p_partkey div 5")).alias("parent_id")))


@query("hp6_sources", "WITH s AS (SELECT DISTINCT coalesce(source, 'naip-2024-hero') AS id, 'L' AS license, 'A' AS attribution FROM documents WHERE source IS NOT NULL), p AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in entries.PERCEPTION) + ") p(id, license, attribution)) SELECT * FROM s UNION ALL SELECT * FROM p WHERE id NOT IN (SELECT id FROM s)")
def sources(spark, sf) -> DataFrame:
    own = table(spark, sf, "documents").where("source is not null").select(F.col("source").alias("id"), F.lit("L").alias("license"), F.lit("A").alias("attribution")).distinct()
    return entries.with_perception(own)


EXACT = {"world_sha256": "w3", "style_id": "c", "style_sha256": "s1", "width": 7623, "height": 3325}


@query("hp20_review_allowed", "SELECT event_id AS id, event_id % 5 = 3 AND event_id % 2 = 0 AND event_id % 3 = 1 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AS allowed FROM events")
def review_allowed(spark, sf) -> DataFrame:
    k = F.col("event_id")
    r = table(spark, sf, "events").select(k.alias("id"), F.concat(F.lit("w"), (k % 5).cast("string")).alias("world_sha256"), F.when(k % 2 == 0, "c").alias("style_id"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("style_sha256"), F.when(k % 7 != 0, 7623).otherwise(1954).alias("width"), F.when(k % 11 != 0, 3325).otherwise(880).alias("height"))
    return entries.review_allowed(r, EXACT)
