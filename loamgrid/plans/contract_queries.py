"""Queries of JSON contracts: documents with planted mistakes, whose codes the SQL knows by the document's number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.durable import fanned_out, written
from loamgrid.operators import checks, contracts
from loamgrid.plans.inputs import table
from loamgrid.plans.registry import query

_SQUARE = lambda x, y, s: f"[[{x},{y},0],[{x + s},{y},0],[{x + s},{y + s},0],[{x},{y + s},0],[{x},{y},0]]"
#: A whole document of three features; ID stands for the part's number.
FIXTURE = (
    f'{{"schema":"{contracts.FIXTURE}","license":"{contracts.LICENSE}","contains_source_pixels":false,"contains_transients":false,"crs":"{contracts.CRS}","origin":{{"epsg":26910,"easting_mm":573000000,"northing_mm":4142000000,"elevation_mm":0}},'
    '"sources":[{"id":"osm","license":"ODbL","attribution":"a"},{"id":"naip","license":"PD","attribution":"b"}],"features":['
    f'{{"id":1,"class":"terrain","confidence_bp":9000,"source_ids":["osm"],"geometry":{{"type":"polygon","rings":[{_SQUARE(0, 0, 5000)}]}}}},'
    f'{{"id":2,"class":"building","name":"hall","height_mm":ID,"confidence_bp":8000,"source_ids":["osm","naip"],"review":"accepted-override","review_note":"seen","geometry":{{"type":"multipolygon","polygons":[{{"rings":[{_SQUARE(10, 10, 800)},{_SQUARE(100, 100, 50)}]}},{{"rings":[{_SQUARE(2000, 10, 700)}]}}]}}}},'
    f'{{"id":3,"class":"building","confidence_bp":10000,"source_ids":["naip"],"parent_id":2,"geometry":{{"type":"polygon","rings":[{_SQUARE(20, 20, 100)}]}}}}]}}'
)
#: What is put in the place of what, and the feature and code that this gives; no code for changes that are allowed.
MISTAKES = [
    ("", "", None, None), ('{"schema"', '["schema"', None, "invalid_root"), (f'"{contracts.LICENSE}"', '"MIT"', None, "invalid_license"), ('"contains_source_pixels":false', '"contains_source_pixels":0', None, "source_pixels"), ('"contains_transients":false', '"contains_transients":true', None, "transients"),
    ("EPSG:26910", "EPSG:4326", None, "invalid_crs"), ('"epsg":26910', '"epsg":"26910"', None, "invalid_origin"), ('"easting_mm":573000000', '"easting_mm":573000000.5', None, "invalid_origin"), ('"sources":[', '"sources_":[', None, "invalid_sources"), ('"license":"PD",', "", None, "invalid_source"), ('"id":"naip"', '"id":"osm"', None, "invalid_source"),
    ('"features":[', '"features":[],"old":[', None, "invalid_features"), ('"id":2', '"id":1', 1, "invalid_id"), ('"id":3', '"id":"3"', 2, "invalid_id"), ('"class":"terrain"', '"class":"lava"', 0, "invalid_class"), ('"confidence_bp":10000', '"confidence_bp":10001', 2, "invalid_confidence"), ('"confidence_bp":9000', '"confidence_bp":"9000"', 0, "invalid_confidence"),
    ('"source_ids":["osm"]', '"source_ids":[]', 0, "missing_source"), ('"source_ids":["naip"]', '"source_ids":["usgs"]', 2, "unknown_source"), (',"review_note":"seen"', "", 1, "missing_review_note"), ('"geometry":{"type":"multipolygon"', '"geometry":{"type":"point"', 1, "invalid_geometry_type"), ('"type":"polygon","rings":[[[20', '"type":"polygon","parts":[[[20', 2, "invalid_polygon"),
    ('"polygons":[', '"polygons":[],"x":[', 1, "invalid_multipolygon"), ("[5000,0,0],[5000,5000,0],[0,5000,0],", "", 0, "invalid_ring"), ("[120,20,0]", "[120,20.5,0]", 2, "invalid_point"), ("[20,120,0],[20,20,0]]", "[20,120,0],[20,21,0]]", 2, "open_ring"), ("[[100,100,0],[150,100,0],[150,150,0],[100,150,0],", "[[100,100,0],[150,100,0],[200,100,0],[150,100,0],", 1, "zero_area"),
    ('"parent_id":2', '"parent_id":9', 2, "unknown_parent"), ('"parent_id":2', '"parent_id":null', None, None), ('"name":"hall",', "", None, None),
]
_QUOTED = lambda s: "'" + s.replace("'", "''") + "'"


def changed(base: str, changes: list[tuple], key: str) -> str:
    """SQL of both engines: the document of a row, changed by its number."""
    cases = " ".join(f"WHEN {i} THEN replace(base, {_QUOTED(c[0])}, {_QUOTED(c[1])})" for i, c in enumerate(changes) if c[0])
    return f"CASE {key} % {len(changes)} {cases} ELSE base END", f"replace({_QUOTED(base)}, 'ID', CAST({key} AS STRING))"


def documents(spark, sf, base: str, changes: list[tuple]) -> DataFrame:
    case, whole = changed(base, changes, "p_partkey")
    keys = fanned_out(table(spark, sf, "part").select("p_partkey"), "p_partkey")  # a few bytes a row, of which long documents are made
    return keys.selectExpr("p_partkey", f"{whole} AS base").selectExpr("p_partkey AS id", f"{case} AS json")


def expected(changes: list[tuple]) -> str:
    rows = ", ".join(f"({i}, {'NULL' if c[2] is None else c[2]}, {_QUOTED(c[3])})" for i, c in enumerate(changes) if c[3])
    return f"x AS (SELECT * FROM (VALUES {rows}) x(k, place, code))"


@query("vl19_hp21_fixtures", f"WITH {expected(MISTAKES)} SELECT p_partkey AS id, place::BIGINT AS place, code FROM part JOIN x ON k = p_partkey % {len(MISTAKES)} UNION ALL SELECT p_partkey, 2, 'unknown_parent' FROM part WHERE p_partkey % {len(MISTAKES)} = 12")  # whose parent has another id then
def fixtures(spark, sf) -> DataFrame:
    return contracts.fixtures(documents(spark, sf, FIXTURE, MISTAKES))


@query("io13_hp4_worlds", f"WITH {expected(MISTAKES)}, good AS (SELECT * FROM part WHERE p_partkey % {len(MISTAKES)} NOT IN (SELECT k FROM x)) SELECT p_partkey AS id, f AS feature_id, CASE f WHEN 1 THEN 'terrain' ELSE 'building' END AS class, CASE WHEN f = 2 AND p_partkey % {len(MISTAKES)} <> {len(MISTAKES) - 1} THEN 'hall' END AS name, CASE f WHEN 2 THEN p_partkey ELSE 0 END AS height_mm, CASE f WHEN 1 THEN 9000 WHEN 2 THEN 8000 ELSE 10000 END::BIGINT AS confidence_bp, CASE f WHEN 1 THEN 'osm' WHEN 2 THEN 'osm,naip' ELSE 'naip' END AS source_ids, CASE WHEN f = 3 AND p_partkey % {len(MISTAKES)} <> {len(MISTAKES) - 2} THEN 2 END::BIGINT AS parent_id, CASE f WHEN 2 THEN 15 ELSE 5 END::BIGINT AS points, CASE f WHEN 1 THEN 10000 WHEN 2 THEN 4440 ELSE 280 END::BIGINT AS sum_x FROM good, range(1, 4) t(f)".replace("CASE f WHEN 1 THEN 10000 WHEN 2 THEN 4440 ELSE 280 END", "CASE f WHEN 1 THEN 10000 WHEN 2 THEN 1650 + 600 + 11400 ELSE 300 END"))
def worlds(spark, sf) -> DataFrame:
    w = contracts.worlds(documents(spark, sf, FIXTURE, MISTAKES))
    every = F.flatten(F.flatten("parts"))
    return w.withColumns({"points": F.size(every).cast("bigint"), "sum_x": F.aggregate(every, F.lit(0).cast("bigint"), lambda s, p: s + p["x"]), "source_ids": F.array_join("source_ids", ",")}).drop("parts")


@query("vl8_origins", "SELECT event_id, 'origin' AS problem FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 4326 ELSE 26910 END AS epsg, event_id * 7919000 % 1000000000 AS e, event_id * 50021000 % 10000500000 - 250000 AS n, event_id * 104729 % 12000000 - 1500000 AS z FROM events) WHERE NOT (epsg = 26910 AND e BETWEEN 100000000 AND 900000000 AND n BETWEEN 0 AND 10000000000 AND z BETWEEN -1000000 AND 10000000)")
def origins(spark, sf) -> DataFrame:
    k = F.col("event_id")
    code = contracts.origin_code(F.when(k % 7 == 0, 4326).otherwise(26910), k * 7919000 % 1000000000, k * 50021000 % F.lit(10000500000) - 250000, k * 104729 % 12000000 - 1500000)
    return table(spark, sf, "events").select("event_id", code.alias("problem")).where("problem is not null")


_CELL = lambda c, r, cls, h: f'{{"index":{{"column":{c},"row":{r}}},"class":"{cls}",{h}"confidence_bp":8000,"source_ids":["a","b"],"naip_sample_count":9,"naip_green_fraction_bp":5000,"lidar_sample_count":4,"lidar_vegetation_fraction_bp":100,"lidar_building_fraction_bp":0,"transient_masked_points":1}}'
ARTIFACT = (
    "{" + ",".join(f'"{k}":"{v}"' for k, v in contracts.EVIDENCE.items()) + ',"contains_source_pixels":false,"contains_transients":false,"grid":{' + ",".join(f'"{k}":{v}' if isinstance(v, int) else f'"{k}":"{v}"' for k, v in contracts.GRID.items())
    + '},"source_sha256":{' + ",".join(f'"s{i}":"{str(i) * 64}"' for i in range(5)) + '},"vector_masked_cell_count":959,"evidence_cell_count":2,"lidar_chunk_points":250000,"cells":[' + _CELL(3, 4, "terrain", '"material":"grass","height_mm":ID,') + "," + _CELL(4, 4, "unknown", '"material":null,"height_mm":0,') + "]}"
)
ARTIFACTS = [
    ("", "", None, None), ('{"schema"', '["schema"', None, "root"), ("evidence/v1", "evidence/v2", None, "policy"), ('"contains_transients":false', '"contains_transients":null', None, "policy"), ('"columns":31', '"columns":"31"', None, "policy"), ('"min_x_mm":43583', '"min_x_mm":43584', None, "policy"), (f'"s4":"{"4" * 64}"', f'"s4":"{"4" * 63}"', None, "provenance"),
    ('"s0":', '"":', None, "provenance"), (f',"s4":"{"4" * 64}"', "", None, "provenance"), ('"evidence_cell_count":2', '"evidence_cell_count":3', None, "accounting"), ('"vector_masked_cell_count":959', '"vector_masked_cell_count":960', None, "accounting"), ('"lidar_chunk_points":250000', '"lidar_chunk_points":1', None, "accounting"),
    ('"column":4', '"column":2', 1, "order"), ('"column":4', '"column":31', 1, "address"), ('"height_mm":0', '"height_mm":7', 1, "unknown"), ('["a","b"],"naip_sample_count":9', '["b","a"],"naip_sample_count":9', None, None),
]


@query("io14_vl9_evidence", f"WITH {expected(ARTIFACTS[:12])} SELECT p_partkey AS id, code FROM part JOIN x ON k = p_partkey % {len(ARTIFACTS)}")
def evidence(spark, sf) -> DataFrame:
    return contracts.evidence(documents(spark, sf, ARTIFACT, ARTIFACTS))


@query("io14_evidence_cells", f"WITH c AS (SELECT p_partkey AS id, p_partkey % {len(ARTIFACTS)} AS m, n FROM part, range(2) t(n) WHERE p_partkey % {len(ARTIFACTS)} NOT BETWEEN 1 AND 11) SELECT concat(id, ':', n) AS key, unnest(CASE WHEN m = 15 THEN ['sources'] WHEN n = 0 THEN [] WHEN m = 12 THEN ['order'] WHEN m = 13 THEN ['address'] WHEN m = 14 THEN ['unknown'] ELSE [] END) AS check_id FROM c")
def evidence_cells(spark, sf) -> DataFrame:
    return checks.evidence_cells(contracts.evidence_cells(documents(spark, sf, ARTIFACT, ARTIFACTS)), "id")


CAPTURE = (
    f'{{"schema":"{contracts.CAPTURE}","bundleId":"pilot-ID","provider":"synthetic","sourceEpoch":"2026","tile":{{"regionId":"r","column":-3,"row":4,"coreWidthPx":512,"coreHeightPx":256,"guardPx":64,"millimetersPerPixel":250,"centerLongitudeE7":-1221680000,"centerLatitudeE7":374270000}},'
    '"camera":{"projection":"orthographic","azimuthMillidegrees":45000,"elevationMillidegrees":30000,"targetAltitudeMm":30000,"nearMm":1000,"farMm":900000,"orthographicWidthMm":160000,"orthographicHeightMm":96000,"cameraDistanceMm":500000},"lighting":{"sunAzimuthMillidegrees":135000,"sunElevationMillidegrees":45000},"readiness":{"timeoutMs":60000,"stableFrames":3,"stableDurationMs":500,"minimumVisibleTiles":4}}'
)
REQUESTS = [
    ("", "", None, None), ('{"schema"', '"schema"', None, "object"), ("capture/v1", "capture/v2", None, "identity"), ('"pilot-', '"../pilot-', None, "identity"), ('"synthetic"', '"other"', None, "identity"), ('"sourceEpoch":"2026"', '"sourceEpoch":""', None, "identity"), ('"lighting":', '"light":', None, "identity"),
    ('"coreWidthPx":512', '"coreWidthPx":"512"', None, "tile"), ('"guardPx":64', '"guardPx":0', None, "tile"), ('"coreWidthPx":512', '"coreWidthPx":3584,"x":1', None, "span"), ('"centerLatitudeE7":374270000', '"centerLatitudeE7":900000001', None, "tile"), ('"orthographic"', '"perspective"', None, "camera"), ('"farMm":900000', '"farMm":1000', None, "camera"),
    ('"cameraDistanceMm":500000', '"cameraDistanceMm":900000', None, "camera"), ('"orthographicWidthMm":160000', '"orthographicWidthMm":160001', None, "span"), ('"sunElevationMillidegrees":45000', '"sunElevationMillidegrees":999', None, "lighting"), ('"stableFrames":3', '"stableFrames":1', None, "readiness"), ('"timeoutMs":60000', '"timeoutMs":60000.5', None, "readiness"),
]


@query("vl14_capture_requests", f"WITH {expected(REQUESTS)} SELECT p_partkey AS id, code FROM part JOIN x ON k = p_partkey % {len(REQUESTS)}")
def captures(spark, sf) -> DataFrame:
    return contracts.captures(documents(spark, sf, CAPTURE, REQUESTS))


_HEX = "0123456789abcdef" * 4
RELEASE = f'{{"schema":"{contracts.RELEASE}","status":"artifact-candidate","qualified":false,"style_id":"v1.c","style_sha256":"{_HEX}","world_sha256":"{_HEX}","dzi":{{"descriptor":"hero.dzi","format":"webp","tile_size":512,"overlap":0,"width":7623,"height":3325,"tile_count":157,"encoded_bytes":1ID,"tile_set_sha256":"{_HEX}"}}}}'
RELEASES = [("", "", None, None), ('"qualified":false', '"qualified":true', None, "x"), ('"qualified":false', '"qualified":null', None, "x"), ("v1.", "v2.", None, "x"), (f'"world_sha256":"{_HEX}"', f'"world_sha256":"{_HEX.upper()}"', None, "x"), ('"tile_size":512', '"tile_size":256', None, "x"), ('"width":7623', '"width":0', None, "x"), ('"overlap":0', '"overlap":"0"', None, "x"), ('"qualified":false', '"qualified":false,"note":1', None, None)]


@query("io31_release_metadata", f"WITH {expected(RELEASES)} SELECT p_partkey AS id, k IS NULL AS valid, CASE WHEN k IS NULL THEN 'v1.c' END AS style_id, CASE WHEN k IS NULL THEN '{_HEX}' END AS style_sha256, CASE WHEN k IS NULL THEN '{_HEX}' END AS world_sha256, CASE WHEN k IS NULL THEN 7623 END::BIGINT AS width, CASE WHEN k IS NULL THEN 3325 END::BIGINT AS height, CASE WHEN k IS NULL THEN 157 END::BIGINT AS tile_count, CASE WHEN k IS NULL THEN concat('1', p_partkey)::BIGINT END AS encoded_bytes, CASE WHEN k IS NULL THEN '{_HEX}' END AS tile_set_sha256 FROM part LEFT JOIN x ON k = p_partkey % {len(RELEASES)}")
def releases(spark, sf) -> DataFrame:
    return contracts.releases(documents(spark, sf, RELEASE, RELEASES))


#: Chains of documents: each order is a chain, its lines documents; a line points to the next one, and some links are broken.
@query("vl20_chains", """WITH d AS (SELECT DISTINCT l_orderkey AS chain, l_linenumber AS n FROM lineitem), doc AS (SELECT chain, n, sha256(concat(chain, '/', n)) AS h FROM d),
l AS (SELECT a.chain, a.n, a.n + 1 AS t, CASE WHEN (a.chain + a.n) % 13 = 0 THEN sha256('other') ELSE sha256(concat(a.chain, '/', a.n + 1)) END AS h FROM d a WHERE a.n < 7 AND (a.chain * 3 + a.n) % 17 <> 0), r AS (SELECT DISTINCT chain, 1 AS n FROM d),
s AS (SELECT chain, t AS n, h FROM l UNION ALL SELECT chain, n, NULL FROM r), w AS (SELECT s.chain, s.n, CASE WHEN doc.h IS NULL THEN 'missing' WHEN bool_or(s.h <> doc.h) THEN 'altered' END AS problem FROM s LEFT JOIN doc USING (chain, n) GROUP BY s.chain, s.n, doc.h),
seen AS (SELECT d.chain, d.n FROM d WHERE NOT EXISTS (SELECT 1 FROM range(1, 8) k(k) WHERE k.k <= d.n AND (NOT EXISTS (SELECT 1 FROM d e WHERE e.chain = d.chain AND e.n = k.k) OR (k.k < d.n AND (d.chain * 3 + k.k) % 17 = 0))))
SELECT chain, n::VARCHAR AS path, problem FROM w WHERE problem IS NOT NULL UNION ALL SELECT chain, n::VARCHAR, 'orphan' FROM d ANTI JOIN seen USING (chain, n)""")
def chains(spark, sf) -> DataFrame:
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chain"), F.col("l_linenumber").alias("n")).distinct()
    d = written(d, "lines")  # what documents, links and roots are made of, each anew for every use
    digest = lambda n: F.sha2(F.concat(F.col("chain").cast("string"), F.lit("/"), n.cast("string")), 256)
    name = lambda n: n.cast("string")
    documents_ = d.select("chain", name(F.col("n")).alias("path"), digest(F.col("n")).alias("sha256"))
    linked = d.where("n < 7 and (chain * 3 + n) % 17 <> 0")
    stated = F.when((F.col("chain") + F.col("n")) % 13 == 0, F.sha2(F.lit("other"), 256)).otherwise(digest(F.col("n") + 1))
    links = linked.select("chain", name(F.col("n")).alias("path"), name(F.col("n") + 1).alias("target"), stated.alias("sha256"))
    return contracts.chains(documents_, links, d.select("chain", F.lit("1").alias("path")).distinct())
