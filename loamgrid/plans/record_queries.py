"""Queries of sources, binary layers and validators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.operators import checks, world
from loamgrid.plans.inputs import table
from loamgrid.plans.registry import query
from loamgrid.sources import binary, documents

#: Records of source locks from parts, a hundred a lock; the same expressions hold in both engines.
LOCKS = {
    "lock_id": "p_partkey - p_partkey % 100", "position": "p_partkey % 100", "id": "concat('s', lpad(CAST(CASE WHEN p_partkey % 50 = 7 THEN p_partkey - 1 ELSE p_partkey END AS STRING), 9, '0'))",
    "kind": "CASE WHEN p_partkey % 41 = 0 THEN '' ELSE 'vector' END", "role": "'base'", "approved": "p_partkey % 31 <> 0", "raw_content_in_final_output": "p_partkey % 37 = 0", "size_bytes": "p_partkey % 43",
    "sha256": "concat(md5(CAST(p_partkey AS STRING)), CASE WHEN p_partkey % 47 = 0 THEN upper(md5('a')) ELSE md5('a') END)", "release": "'r1'", "source_date": "CASE WHEN p_partkey % 53 = 0 THEN '' ELSE '2026' END", "acquired_at": "'2026'",
    "license": "CASE WHEN p_partkey % 3 = 0 THEN 'CC0' ELSE 'ODbL' END", "attribution": "p_name", "metadata_url": "CASE WHEN p_partkey % 59 = 0 THEN NULL ELSE 'https://example.org/m' END",
    "acquisition_kind": "CASE WHEN p_partkey % 2 = 0 THEN 'https' ELSE 'local' END", "url": "CASE WHEN p_partkey % 2 = 0 THEN CASE p_partkey % 12 WHEN 0 THEN 'http://example.org/a' WHEN 2 THEN 'https://maps.googleapis.com/a' ELSE 'https://example.org/a' END END",
    "etag": "CASE WHEN p_partkey % 2 = 0 THEN CASE p_partkey % 10 WHEN 0 THEN '\"abc\"' WHEN 2 THEN '\"\"' WHEN 4 THEN 'abc' WHEN 6 THEN '\"a b\"' END END",
    "path": "CASE WHEN p_partkey % 2 = 1 THEN CASE p_partkey % 14 WHEN 1 THEN '/data/a' WHEN 3 THEN 'data/../a' WHEN 5 THEN '..' ELSE 'data/..a/b' END END",
    "filename": "CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'a/b' WHEN 2 THEN 'a\\\\b' ELSE 'a.json' END",
}
LOCKS_SQL = "lk AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in LOCKS.items()).replace("AS STRING", "AS VARCHAR").replace("a\\\\b", "a\\b") + " FROM part)"


def lock_rows(spark, sf) -> DataFrame:
    return table(spark, sf, "part").selectExpr(*[f"{e} AS {n}" for n, e in LOCKS.items()])


def lock_documents(spark, sf) -> DataFrame:
    """The records as JSON documents, one a lock."""
    inner = F.struct("id", "kind", "role", "approved", "raw_content_in_final_output", "size_bytes", "sha256", "release", "source_date", "acquired_at", "license", "attribution", "metadata_url", F.struct(F.col("acquisition_kind").alias("kind"), "url", "etag", "path", "filename").alias("acquisition"))
    rows = lock_rows(spark, sf).groupBy("lock_id").agg(F.array_sort(F.collect_list(F.struct("position", inner.alias("r")))).alias("_r"))
    region = F.when(F.col("lock_id") % 300 == 0, "elsewhere").otherwise("here")
    return rows.select("lock_id", F.to_json(F.struct(F.lit("lock/v1").alias("schema"), region.alias("region_id"), F.transform("_r", lambda r: r["r"]).alias("sources"))).alias("content"))


def broken(rules: dict[str, str], key: str, source: str) -> str:
    cases = ", ".join(f"CASE WHEN NOT coalesce({ok}, FALSE) THEN '{name}' END" for name, ok in rules.items())
    return f"SELECT {key} AS key, check_id FROM (SELECT *, unnest([{cases}]) AS check_id FROM {source}) WHERE check_id IS NOT NULL"


@query("io1_vl1_vl2_lock_records", f"WITH {LOCKS_SQL}, o AS (SELECT *, lag(id) OVER (PARTITION BY lock_id ORDER BY position) AS last FROM lk) " + broken({
    "approved": "approved", "raw": "NOT raw_content_in_final_output", "named": "kind <> ''", "order": "last IS NULL OR last < id", "size": "size_bytes > 0", "digest": "regexp_full_match(sha256, '[0-9a-f]{64}')", "provenance": "source_date <> '' AND metadata_url IS NOT NULL",
    "https": "url IS NULL OR url LIKE 'https://%'", "host": "url IS NULL OR url NOT LIKE '%googleapis.%'", "etag": "etag IS NULL OR etag = '\"abc\"'", "path": "path IS NULL OR path = 'data/..a/b'", "filename": "filename = 'a.json'",
}, "concat(lock_id, ':', position)", "o"))
def lock_records(spark, sf) -> DataFrame:
    records = documents.lock_records(documents.parsed(lock_documents(spark, sf), documents.LOCK), "lock_id")
    flat = records.select("*", F.col("acquisition.kind").alias("acquisition_kind"), *[F.col(f"acquisition.{c}").alias(c) for c in ("url", "etag", "path", "filename")])
    return checks.lock_records(flat)


@query("io16_headers", f"WITH {LOCKS_SQL} SELECT lock_id::VARCHAR AS key, 'region' AS check_id FROM lk WHERE lock_id % 300 = 0 GROUP BY lock_id")
def headers(spark, sf) -> DataFrame:
    return checks.headers(documents.parsed(lock_documents(spark, sf), documents.LOCK), "lock_id", "lock/v1", "here")


@query("io2_selected", f"WITH {LOCKS_SQL} SELECT lock_id, position, id FROM lk WHERE id IN ('s000000003', 's000000006')")
def selected(spark, sf) -> DataFrame:
    return documents.selected(lock_rows(spark, sf).select("lock_id", "position", "id"), ["s000000003", "s000000006"])


_ARTIFACTS = "SELECT doc_id, sha256(coalesce(text, '')) AS digest, strlen(coalesce(text, ''))::BIGINT AS n FROM documents"


@query("io3_io4_io8_verified", f"WITH a AS ({_ARTIFACTS}) SELECT doc_id AS id, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'length' WHEN doc_id % 7 = 0 THEN 'digest' END AS problem FROM a")
def verified(spark, sf) -> DataFrame:
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf, "documents").select("doc_id", body.alias("content"))
    # One id in seven locks another digest, one in eleven another length, one in thirteen names a file that is not there.
    id_ = F.col("doc_id")
    records = docs.select(id_.alias("id"), F.sha2(F.when(id_ % 7 == 0, F.concat(F.col("content"), F.encode(F.lit("x"), "UTF-8"))).otherwise(F.col("content")), 256).alias("sha256"), (F.octet_length("content") + F.when(id_ % 11 == 0, 1).otherwise(0)).cast("bigint").alias("size_bytes"), F.concat(id_.cast("string"), F.lit(".txt")).alias("filename"))
    files = records.join(docs, F.col("id") == F.col("doc_id")).where(id_ % 13 != 0).select(documents.artifact_path(F.col("sha256"), F.col("filename")).alias("path"), F.octet_length("content").cast("bigint").alias("length"), "content")
    return documents.verified(records, files)


_WAYS = "SELECT doc_id, p_partkey, p_name, p_size FROM (SELECT p_partkey - p_partkey % 10 AS doc_id, p_partkey, p_name, p_size FROM part)"


@query("io9_osm_ways", f"SELECT p_partkey AS way_id, p_name AS name, p_partkey % 4 + 1 AS points, p_size::DOUBLE AS lon FROM ({_WAYS}) WHERE p_partkey % 5 <> 0")
def osm_ways(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    point = F.struct(F.col("p_size").cast("double").alias("lon"), F.lit(37.5).alias("lat"))
    kind = F.when(F.col("p_partkey") % 5 == 0, "node").otherwise("way")
    element = F.struct(kind.alias("type"), F.col("p_partkey").alias("id"), F.create_map(F.lit("name"), F.col("p_name")).alias("tags"), F.array_repeat(point, (F.col("p_partkey") % 4 + 1).cast("int")).alias("geometry"))
    docs = p.groupBy((F.col("p_partkey") - F.col("p_partkey") % 10).alias("doc_id")).agg(F.collect_list(element).alias("elements")).select("doc_id", F.to_json(F.struct("elements")).alias("content"))
    return documents.ways(documents.parsed(docs, documents.WAYS)).select("way_id", F.col("tags")["name"].alias("name"), F.size("path").cast("bigint").alias("points"), F.col("path")[0]["lon"].alias("lon"))


@query("io10_geojson", "SELECT concat('f', p_partkey) AS feature_id, CASE p_partkey % 3 WHEN 0 THEN 'Polygon' WHEN 1 THEN 'MultiPolygon' ELSE 'Point' END AS kind, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END::BIGINT AS parts, CASE WHEN p_partkey % 3 < 2 THEN p_size END::DOUBLE AS x FROM part")
def geojson(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    ring = F.format_string("[[[%d, 1.5], [2, 2], [3, 1], [%d, 1.5]]]", "p_size", "p_size")
    coordinates = F.when(F.col("p_partkey") % 3 == 0, ring).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("["), ring, F.lit(","), ring, F.lit("]"))).otherwise("[1, 2]")
    kind = F.when(F.col("p_partkey") % 3 == 0, "Polygon").when(F.col("p_partkey") % 3 == 1, "MultiPolygon").otherwise("Point")
    docs = p.select(F.format_string('{"features": [{"id": "f%d", "geometry": {"type": "%s", "coordinates": %s}, "properties": {}}]}', "p_partkey", kind, coordinates).alias("content"))
    found = documents.polygons(documents.parsed(docs, documents.FEATURES))
    return found.select("feature_id", "kind", F.when(F.col("parts").isNotNull(), F.size("parts")).cast("bigint").alias("parts"), F.col("parts")[0][0][0][0].alias("x"))


_PIXELS = {"file_id": "p_partkey - p_partkey % 40", "y": "(p_partkey % 40 - p_partkey % 8) / 8", "x": "p_partkey % 8", "class": "p_partkey % 24", "confidence": "p_size * 5", "evidence": "p_partkey * 37 % 65536", "instance": "p_partkey * 1000003 % 4294967296"}
_PIXELS_SQL = ", ".join(f"({e.replace('/', '//')})::BIGINT AS {n}" for n, e in _PIXELS.items())


@query("io15_mask_round_trip", f"SELECT {_PIXELS_SQL} FROM part")
def mask_round_trip(spark, sf) -> DataFrame:
    pixels = table(spark, sf, "part").selectExpr(*[f"CAST({e} AS BIGINT) AS {n}" for n, e in _PIXELS.items()])
    return binary.mask_pixels(binary.mask_files(pixels))


@query("io17_io18_headers", """SELECT p_partkey, w AS width, h AS height, p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND w > 0 AS valid, p_partkey % 3 <> 0 AND p_partkey % 4 <> 0 AS png FROM (SELECT p_partkey, p_size % 20 AS w, p_partkey % 6 + 1 AS h FROM part)""")
def layer_headers(spark, sf) -> DataFrame:
    k, w, h = F.col("p_partkey"), (F.col("p_size") % 20).cast("bigint"), F.col("p_partkey") % 6 + 1
    magic = F.when(k % 5 == 0, b"ISOD32V2".hex()).otherwise(binary.DEPTH.encode().hex())
    body = F.repeat(F.lit("01020304"), (w * h + F.when(k % 7 == 0, 1).otherwise(0)).cast("int"))
    depth = F.unhex(F.concat(magic, binary.little_hex(w), binary.little_hex(h), body))
    png = F.unhex(F.concat(F.lit(binary.PNG), F.lit("0000000D49484452"), F.lit("0000001000000010"), F.when(k % 3 == 0, "10").otherwise("08"), F.when(k % 4 == 0, "00").otherwise("06")))
    at = table(spark, sf, "part").select(k, binary.depth_header(depth).alias("_h"), binary.png_header(png, "rgba").alias("png"))
    return at.select("p_partkey", "_h.width", "_h.height", "_h.valid", "png")


@query("io20_io24_tiles", """SELECT p_partkey, p_partkey % 3 <> 0 AS valid, concat('<?xml version="1.0" encoding="UTF-8"?>', chr(10), '<Image TileSize="512" Overlap="0" Format="webp" xmlns="http://schemas.microsoft.com/deepzoom/2008">', chr(10), '  <Size Width="', p_size, '" Height="4"/>', chr(10), '</Image>', chr(10)) AS descriptor FROM part""")
def tiles(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    content = F.unhex(F.concat(F.lit("4953494458310000"), F.lit("0200000002000000"), F.lit("000102"), F.when(k % 3 == 0, "09").otherwise("07")))
    return table(spark, sf, "part").select(k, binary.tile_header(content, F.lit(8))["valid"].alias("valid"), documents.descriptor(F.col("p_size").cast("bigint"), F.lit(4), 512, 0, "webp").alias("descriptor"))


#: World objects from parts.
OBJECTS = {
    "id": "p_partkey", "world_id": "p_partkey - p_partkey % 200", "position": "CASE WHEN p_partkey % 90 = 1 THEN p_partkey + 3 ELSE p_partkey END", "name": "CASE p_partkey % 10 WHEN 0 THEN '  ' WHEN 1 THEN repeat('é', 129) WHEN 2 THEN NULL ELSE p_name END",
    "class": "CASE p_partkey % 4 WHEN 0 THEN 'building' WHEN 1 THEN 'road' WHEN 2 THEN 'building' ELSE CASE WHEN p_partkey % 12 = 3 THEN 'unknown' ELSE 'water' END END",
    "floor_count": "CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 3 END", "roof": "CASE WHEN p_partkey % 15 = 0 THEN 'flat' END", "parent_id": "CASE WHEN p_partkey % 8 = 4 THEN p_partkey - 4 WHEN p_partkey % 16 = 8 THEN p_partkey + 4 WHEN p_partkey % 16 = 2 THEN 900000000 WHEN p_partkey % 16 = 6 THEN p_partkey - 1 END",
    "review": "CASE p_partkey % 5 WHEN 0 THEN 'accepted-override' WHEN 1 THEN 'unreviewed-conflict' ELSE 'accepted' END", "review_note": "CASE p_partkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'seen' END",
}
OBJECTS_SQL = f"obj AS (SELECT {', '.join(f'{e} AS {n}' for n, e in OBJECTS.items())}, CASE p_partkey % 9 WHEN 0 THEN [] WHEN 1 THEN ['b', 'a'] WHEN 2 THEN ['a', 'a'] ELSE ['a', 'b'] END AS source_ids FROM part)"


def objects(spark, sf) -> DataFrame:
    k = F.col("p_partkey") % 9
    sources = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("b"), F.lit("a"))).when(k == 2, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return table(spark, sf, "part").select(*[F.expr(e).alias(n) for n, e in OBJECTS.items()], sources.alias("source_ids"))


@query("vl6_objects", f"WITH {OBJECTS_SQL} " + broken({
    "name": "name IS NULL OR (trim(name) <> '' AND strlen(name) <= 256)", "provenance": "len(source_ids) > 0", "source_order": "source_ids = [] OR source_ids = ['a', 'b']", "parent": "parent_id IS NULL OR class = 'building'", "floors": "(floor_count IS NULL AND roof IS NULL) OR class = 'building'",
    "no_floor": "floor_count IS NULL OR floor_count > 0", "unknown": "class <> 'unknown' OR review = 'unreviewed-conflict'", "note": "review = 'accepted' OR review_note = 'seen'",
}, "id::VARCHAR", "obj"))
def object_rules(spark, sf) -> DataFrame:
    return checks.object_rules(objects(spark, sf))


@query("vl7_parents", f"""WITH RECURSIVE {OBJECTS_SQL}, step AS (SELECT c.id, c.parent_id FROM obj c JOIN obj p ON c.parent_id = p.id), far(id, up, n) AS (SELECT id, parent_id, 1 FROM step UNION ALL SELECT far.id, step.parent_id, n + 1 FROM far JOIN step ON far.up = step.id WHERE n < 40)
SELECT c.id::VARCHAR AS key, CASE WHEN p.id IS NULL THEN 'unknown' ELSE 'building' END AS check_id FROM obj c LEFT JOIN obj p ON c.parent_id = p.id WHERE c.parent_id IS NOT NULL AND (p.id IS NULL OR p.class <> 'building') UNION ALL SELECT id::VARCHAR, 'cycle' FROM far WHERE n = 40""")
def parents(spark, sf) -> DataFrame:
    return checks.parents(objects(spark, sf))


@query("vl16_qualified", f"WITH {OBJECTS_SQL}, o AS (SELECT *, lag(id) OVER (PARTITION BY world_id ORDER BY position) AS last FROM obj) " + broken({"order": "last IS NULL OR last < id", "unknown": "class <> 'unknown'"}, "concat(world_id, ':', position)", "o"))
def qualified(spark, sf) -> DataFrame:
    return checks.qualified(objects(spark, sf))


CELLS = {
    "artifact_id": "p_partkey - p_partkey % 500", "position": "p_partkey % 500", "col": "CASE WHEN p_partkey % 70 = 3 THEN 31 ELSE p_partkey % 500 % 31 END", "row": "(p_partkey % 500 - p_partkey % 500 % 31) / 31", "samples": "p_partkey % 23", "confidence_bp": "p_size * 205", "green_bp": "p_size * 10", "vegetation_bp": "p_size", "building_bp": "0",
    "class": "CASE WHEN p_partkey % 6 = 0 THEN 'unknown' ELSE 'dry' END", "material": "CASE WHEN p_partkey % 4 = 0 THEN 'soil' END", "height_mm": "p_partkey % 3",
}
CELLS_SQL = f"cl AS (SELECT {', '.join(f'{e.replace(chr(47), chr(47) * 2)} AS {n}' for n, e in CELLS.items())} FROM part)"


def cells(spark, sf) -> DataFrame:
    rows = table(spark, sf, "part").selectExpr(*[f"{e} AS {n}" for n, e in CELLS.items()])
    return rows.withColumn("row", F.col("row").cast("bigint")).withColumn("source_ids", F.array(F.lit("a")))


@query("vl9_evidence_cells", f"WITH {CELLS_SQL}, o AS (SELECT *, lag(row) OVER w AS r0, lag(col) OVER w AS c0 FROM cl WINDOW w AS (PARTITION BY artifact_id ORDER BY position)) " + broken({
    "address": "col BETWEEN 0 AND 30 AND row BETWEEN 0 AND 30", "order": "r0 IS NULL OR r0 < row OR (r0 = row AND c0 < col)", "samples": "samples > 0", "shares": "confidence_bp <= 10000", "unknown": "class <> 'unknown' OR (material IS NULL AND height_mm = 0)"}, "concat(artifact_id, ':', position)", "o"))
def evidence_cells(spark, sf) -> DataFrame:
    return checks.evidence_cells(cells(spark, sf))


@query("se5_accounted", f"WITH {CELLS_SQL} SELECT artifact_id, 961 - count(DISTINCT (col, row)) AS masked, count(DISTINCT (col, row)) AS eligible, count(*) = count(DISTINCT (col, row)) AS whole FROM cl GROUP BY artifact_id")
def accounted(spark, sf) -> DataFrame:
    return checks.accounted(cells(spark, sf))


@query("jn16_rights", f"WITH {LOCKS_SQL}, f AS (SELECT p_partkey, concat('s', lpad(p_partkey::VARCHAR, 9, '0')) AS id, CASE WHEN p_partkey % 4 = 0 THEN 'CC0' ELSE 'ODbL' END AS license, p_name AS attribution FROM part) SELECT f.id, CASE WHEN k.id IS NULL THEN 'unknown' ELSE 'rights' END AS problem FROM f LEFT JOIN lk k USING (id) WHERE k.id IS NULL OR f.license <> k.license OR f.attribution <> k.attribution")
def rights(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    fixture = table(spark, sf, "part").select(F.concat(F.lit("s"), F.lpad(k.cast("string"), 9, "0")).alias("id"), F.when(k % 4 == 0, "CC0").otherwise("ODbL").alias("license"), F.col("p_name").alias("attribution"))
    return checks.matched_rights(fixture, lock_rows(spark, sf))


@query("vl24_tile_requests", "WITH r AS (SELECT o_orderkey AS id, o_orderkey * 7 % 2100 AS side, o_orderkey * 3 % 600 AS guard, 80 AS needed, o_orderkey * 11 % 8000 AS x, o_orderkey * 5 % 3400 AS y FROM orders) " + broken({"side": "side BETWEEN 1 AND 2048", "guard": "guard BETWEEN 80 AND 512", "origin": "x <= 7622 AND y <= 3324"}, "id::VARCHAR", "r"))
def tile_requests(spark, sf) -> DataFrame:
    o = F.col("o_orderkey")
    return checks.tile_requests(table(spark, sf, "orders").select(o.alias("id"), (o * 7 % 2100).alias("side"), (o * 3 % 600).alias("guard"), F.lit(80).alias("needed"), (o * 11 % 8000).alias("x"), (o * 5 % 3400).alias("y"), F.lit(7623).alias("layout_width"), F.lit(3325).alias("layout_height")))


@query("vl18_raster_inputs", "WITH r AS (SELECT event_id, event_id * 3 % 700 AS v, CASE event_id % 9 WHEN 0 THEN 128 WHEN 1 THEN 0 ELSE 255 END AS coverage FROM events) " + broken({"coverage": "coverage <> 128", "depth": "coverage <> 255 OR v BETWEEN 1 AND 600"}, "concat('0:', event_id, ':0')", "r"))
def raster_inputs(spark, sf) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf, "events").select(F.lit(0).alias("raster_id"), e.alias("y"), F.lit(0).alias("x"), (e * 3 % 700).alias("v"), F.when(e % 9 == 0, 128).when(e % 9 == 1, 0).otherwise(255).alias("coverage"))
    return checks.raster_inputs(rows, 600)


@query("sf5_sf6_cells", "SELECT o_orderkey, CASE WHEN x BETWEEN 43583 AND 663582 AND y BETWEEN 86784 AND 706783 THEN (y - 86784) // 20000 * 31 + (x - 43583) // 20000 END AS cell FROM (SELECT o_orderkey, o_orderkey * 7919 % 800000 AS x, o_orderkey * 50021 % 800000 AS y FROM orders)")
def grid_cells(spark, sf) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", world.cell_of(o * 7919 % 800000, o * 50021 % 800000).alias("cell"))


@query("jn4_cell_evidence", f"WITH {CELLS_SQL}, e AS (SELECT DISTINCT artifact_id, col, row FROM cl), w AS (SELECT artifact_id, a.i % 31 AS col, a.i // 31 AS row FROM (SELECT DISTINCT artifact_id FROM cl), range(961) a(i) WHERE a.i % 3 <> 0) SELECT coalesce(w.artifact_id, e.artifact_id) AS artifact_id, coalesce(w.col, e.col) AS col, coalesce(w.row, e.row) AS row, CASE WHEN w.col IS NULL THEN 'unexpected' ELSE 'missing' END AS problem FROM w FULL JOIN e ON w.artifact_id = e.artifact_id AND w.col = e.col AND w.row = e.row WHERE w.col IS NULL OR e.col IS NULL")
def cell_evidence(spark, sf) -> DataFrame:
    found = cells(spark, sf).select("artifact_id", "col", "row").distinct()
    grid = found.select("artifact_id").distinct().select("artifact_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(960).cast("bigint"))).alias("i")).where("i % 3 <> 0")
    return world.mismatched_cells(grid.select("artifact_id", (F.col("i") % 31).alias("col"), F.expr("i div 31").alias("row")), found, ("artifact_id", "col", "row"))


@query("ag25_inspection", f"WITH {OBJECTS_SQL} SELECT count(*) AS objects, count(name) AS named, count(DISTINCT class) AS classes, (SELECT count(DISTINCT s) FROM (SELECT unnest(source_ids) AS s FROM obj)) AS sources FROM obj")
def inspection(spark, sf) -> DataFrame:
    return world.inspection(objects(spark, sf))
