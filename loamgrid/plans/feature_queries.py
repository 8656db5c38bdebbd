"""Queries of tags, projections and display values, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.functions import display, projection, tags
from loamgrid.operators import buildings
from loamgrid.plans.inputs import table
from loamgrid.plans.registry import query

#: Tags of parts as ways; the same expressions hold in both engines.
TAGS = {
    "roof_shape": "CASE p_partkey % 7 WHEN 0 THEN 'gabled' WHEN 1 THEN 'hipped' WHEN 2 THEN 'pyramidal' WHEN 3 THEN 'skillion' WHEN 4 THEN 'flat' WHEN 5 THEN 'onion' END",
    "roof_direction": "CASE p_partkey % 4 WHEN 0 THEN concat(p_size * 37, '') WHEN 1 THEN concat(' -', p_size, '.5 ;x') WHEN 2 THEN 'west' END",
    "levels": "CASE p_partkey % 5 WHEN 0 THEN concat(p_size % 12, ';2') WHEN 1 THEN concat(' +', p_size) WHEN 2 THEN 'many' WHEN 3 THEN '-1' END",
    "height": "CASE p_partkey % 11 WHEN 0 THEN '12.5' WHEN 1 THEN '2000' WHEN 2 THEN '7 m' WHEN 3 THEN concat(p_size, '.25') WHEN 4 THEN '1e1' WHEN 5 THEN '5d' END",
    "highway": "CASE p_partkey % 9 WHEN 0 THEN 'tertiary' WHEN 1 THEN 'residential' WHEN 2 THEN 'service' WHEN 3 THEN 'pedestrian' WHEN 4 THEN 'cycleway' WHEN 5 THEN 'steps' WHEN 6 THEN 'track' END",
    "width": "CASE p_partkey % 6 WHEN 0 THEN concat(p_size % 9, '.75') WHEN 1 THEN 'wide' WHEN 2 THEN '1001' END",
    "natural": "CASE p_partkey % 13 WHEN 0 THEN 'water' WHEN 1 THEN 'wood' WHEN 2 THEN 'sand' END",
    "amenity": "CASE p_partkey % 8 WHEN 0 THEN 'parking' WHEN 1 THEN 'cafe' END",
    "leisure": "CASE p_partkey % 10 WHEN 0 THEN 'pitch' WHEN 1 THEN 'park' WHEN 2 THEN 'common' WHEN 3 THEN 'marina' END",
    "landuse": "CASE p_partkey % 17 WHEN 0 THEN 'forest' END",
}
KEYS = {"roof_shape": "roof:shape", "roof_direction": "roof:direction", "levels": "building:levels"}
TAGS_SQL = f"feat AS (SELECT p_partkey AS way_id, p_name AS name, {', '.join(f'{e} AS {n}' if n != 'natural' else f'{e} AS nat' for n, e in TAGS.items())} FROM part)"
_NUM = r"'[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?'"
_PART = lambda c: f"trim(split_part({c}, ';', 1))"
_NUMBER = lambda c: f"CASE WHEN regexp_full_match({_PART(c)}, {_NUM}) THEN {_PART(c)}::DOUBLE END"
_COUNT = lambda c: f"CASE WHEN regexp_full_match({_PART(c)}, '[+]?[0-9]+') AND {_PART(c)}::BIGINT <= 65535 THEN {_PART(c)}::BIGINT END"
_MM = lambda c: f"CASE WHEN ({c}) BETWEEN 0 AND 1000 THEN round(({c}) * 1000)::BIGINT END"


def ways(spark, sf) -> DataFrame:
    """way_id, name and tags of parts."""
    flat = table(spark, sf, "part").selectExpr("p_partkey AS way_id", "p_name AS name", *[f"{e} AS {n}" for n, e in TAGS.items()])
    every = F.create_map(*[x for n in TAGS for x in (F.lit(KEYS.get(n, n)), F.col(n))])
    return flat.select("way_id", "name", F.map_filter(every, lambda k, v: v.isNotNull()).alias("tags"))


@query("sf17_sf20_road_width", f"""WITH {TAGS_SQL} SELECT way_id, {_COUNT('levels')} AS floors, CASE WHEN highway IS NOT NULL THEN coalesce({_MM(_NUMBER('width'))},
  CASE highway WHEN 'tertiary' THEN 10000 WHEN 'residential' THEN 7000 WHEN 'service' THEN 5000 WHEN 'pedestrian' THEN 4000 WHEN 'cycleway' THEN 2500 WHEN 'steps' THEN 2000 ELSE 2200 END) END::BIGINT AS width_mm FROM feat""")
def road_width(spark, sf) -> DataFrame:
    return ways(spark, sf).select("way_id", tags.small_count(F.col("tags")["building:levels"]).alias("floors"), tags.road_width(F.col("tags")).alias("width_mm"))


@query("sf21_surface", f"""WITH {TAGS_SQL}, c AS (SELECT way_id, CASE WHEN nat = 'water' THEN 1 WHEN nat = 'wood' THEN 2 WHEN amenity = 'parking' THEN 3 WHEN leisure = 'pitch' THEN 4
  WHEN landuse IS NOT NULL OR leisure IN ('park', 'common', 'garden') THEN 5 END AS k FROM feat)
SELECT way_id, ['water', 'vegetation', 'parking', 'athletic-surface', 'terrain'][k] AS class, ['water', 'broadleaf', 'asphalt', 'athletic-turf', 'grass'][k] AS material FROM c""")
def surface(spark, sf) -> DataFrame:
    return ways(spark, sf).withColumn("s", tags.surface(F.col("tags"))).select("way_id", "s.class", "s.material")


@query("sf22_roof", f"""WITH {TAGS_SQL}, d AS (SELECT way_id, roof_shape, {_NUMBER('roof_direction')} AS turn FROM feat)
SELECT way_id, CASE WHEN roof_shape = 'skillion' THEN 'shed' WHEN roof_shape = 'onion' THEN 'unknown' ELSE roof_shape END AS kind,
  CASE WHEN roof_shape IS NOT NULL THEN coalesce(round((((turn % 360) + 360) % 360) * 1000), 0)::BIGINT END AS direction FROM d""")
def roof(spark, sf) -> DataFrame:
    return ways(spark, sf).withColumn("r", tags.roof(F.col("tags"))).select("way_id", "r.kind", "r.direction")


_RECORDS = "SELECT c_custkey AS building_id, CASE WHEN c_custkey % 6 = 0 THEN concat('r', c_custkey) ELSE concat('w', c_custkey * 3 % 2500, '@', c_custkey % 4) END AS record_id, CASE c_custkey % 7 WHEN 0 THEN 12.5 WHEN 1 THEN 1500.0 WHEN 2 THEN c_custkey % 90 + 0.5 END AS metres, CASE c_custkey % 5 WHEN 0 THEN c_custkey % 30 END AS num_floors FROM customer"


def records(spark, sf) -> DataFrame:
    """Building records with their own height (m) and floors, from customers."""
    body = _RECORDS.removeprefix("SELECT ").removesuffix(" FROM customer")
    return table(spark, sf, "customer").selectExpr(*_columns(body)).withColumns({"metres": F.col("metres").cast("double"), "num_floors": F.col("num_floors").cast("bigint")})


def _columns(body: str) -> list[str]:
    """The select list cut at its outer commas."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(body[last:i])
            last = i + 1
    return [*out, body[last:]]


BUILDINGS_SQL = f"""rec AS ({_RECORDS}),
joined AS (SELECT building_id, record_id, metres::DOUBLE AS metres, name, f.way_id, CASE WHEN regexp_matches(record_id, '^w[0-9]+(@|$)') THEN regexp_extract(record_id, '^w([0-9]+)', 1)::BIGINT END AS osm_id,
  coalesce(num_floors, {_COUNT('levels')})::BIGINT AS floors FROM rec LEFT JOIN feat f ON regexp_matches(record_id, '^w[0-9]+(@|$)') AND regexp_extract(record_id, '^w([0-9]+)', 1) = f.way_id::VARCHAR)"""


@query("jn1_sf23_buildings", f"""WITH {TAGS_SQL}, {BUILDINGS_SQL} SELECT building_id, osm_id, name, floors, CASE WHEN metres IS NULL OR metres <= 1000 THEN coalesce(round(metres * 1000)::BIGINT, floors * 3600, 9000) END AS height_mm,
  CASE WHEN metres IS NULL AND floors IS NULL THEN 7000 ELSE 9500 END::BIGINT AS confidence_bp, coalesce(metres > 1000, FALSE) AS wrong, CASE WHEN way_id IS NULL THEN 1 ELSE 2 END::BIGINT AS n_sources FROM joined""")
def enriched(spark, sf) -> DataFrame:
    return buildings.enriched(records(spark, sf), ways(spark, sf)).withColumn("n_sources", F.size("source_ids").cast("bigint")).drop("source_ids", "record_id")


@query("jn2_unused_ways", f"""WITH {TAGS_SQL}, {BUILDINGS_SQL}, h AS (SELECT way_id, {_COUNT('levels')} AS floors, {_NUMBER('height')} AS m FROM feat WHERE levels IS NOT NULL AND way_id NOT IN (SELECT osm_id FROM joined WHERE osm_id IS NOT NULL))
SELECT way_id, floors, CASE WHEN m IS NULL OR m <= 1000 THEN coalesce(round(m * 1000)::BIGINT, floors * 3600, 9000) END AS height_mm, CASE WHEN m IS NULL AND floors IS NULL THEN 6500 ELSE 8500 END::BIGINT AS confidence_bp, coalesce(m > 1000, FALSE) AS wrong FROM h""")
def unused(spark, sf) -> DataFrame:
    return buildings.unused(ways(spark, sf).where(F.col("tags")["building:levels"].isNotNull()), records(spark, sf))


_A, _E = "6378137e0", "6.6943799901413165e-3"
_LONLAT = "SELECT event_id, -122.31 + (event_id * 7919 % 33000) / 100000.0::DOUBLE AS lon, 37.29 + (event_id * 104729 % 33000) / 100000.0::DOUBLE AS lat FROM events"
_UTM = f"""ll AS ({_LONLAT}), p AS (SELECT *, radians(lat) AS f, sin(radians(lat)) AS s, cos(radians(lat)) AS c, tan(radians(lat)) AS t, {_E} / (1 - {_E}) AS q, cos(radians(lat)) * radians(lon + 123) AS a FROM ll),
r AS (SELECT *, {_A} / sqrt(1 - {_E} * s * s) AS n, t * t AS t2, q * c * c AS c2,
  {_A} * ((1 - {_E} / 4 - 3 * {_E} * {_E} / 64 - 5 * {_E} * {_E} * {_E} / 256) * f - (3 * {_E} / 8 + 3 * {_E} * {_E} / 32 + 45 * {_E} * {_E} * {_E} / 1024) * sin(2 * f) + (15 * {_E} * {_E} / 256 + 45 * {_E} * {_E} * {_E} / 1024) * sin(4 * f) - 35 * {_E} * {_E} * {_E} / 3072 * sin(6 * f)) AS m FROM p),
utm AS (SELECT event_id, lon, lat, 500000 + 0.9996 * n * (a + (1 - t2 + c2) * pow(a, 3) / 6 + (5 - 18 * t2 + t2 * t2 + 72 * c2 - 58 * q) * pow(a, 5) / 120) AS e,
  0.9996 * (m + n * t * (a * a / 2 + (5 - t2 + 9 * c2 + 4 * c2 * c2) * pow(a, 4) / 24 + (61 - 58 * t2 + t2 * t2 + 600 * c2 - 330 * q) * pow(a, 6) / 720)) AS nn FROM r)"""


def places(spark, sf) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", (F.lit(-122.31) + (e * 7919 % 33000) / F.lit(100000.0)).alias("lon"), (F.lit(37.29) + (e * 104729 % 33000) / F.lit(100000.0)).alias("lat"))


@query("sf1_utm", f"WITH {_UTM} SELECT event_id, round(e * 1000)::BIGINT AS easting_mm, round(nn * 1000)::BIGINT AS northing_mm FROM utm")
def utm(spark, sf) -> DataFrame:
    at = places(spark, sf).withColumn("u", projection.utm10(F.col("lon"), F.col("lat")))
    return at.select("event_id", F.round(F.col("u.easting") * 1000).cast("bigint").alias("easting_mm"), F.round(F.col("u.northing") * 1000).cast("bigint").alias("northing_mm"))


@query("sf2_ge12_local", f"WITH {_UTM} SELECT event_id, round(e * 1000)::BIGINT - 573200000 AS x, round(nn * 1000)::BIGINT - 4142200000 AS y FROM utm WHERE lon BETWEEN -122.3 AND -122.0 AND lat BETWEEN 37.3 AND 37.6")
def local(spark, sf) -> DataFrame:
    at = places(spark, sf).withColumn("p", projection.local(F.col("lon"), F.col("lat"))).where("p is not null")
    return at.select("event_id", "p.x", "p.y")


_N, _F, _TOP = (f"{v!r}e0" for v in projection.cone_constants())


@query("sf3_state_plane", f"""WITH RECURSIVE f AS (SELECT {_N} AS n, {_F} AS f, {_TOP} AS top, sqrt({projection.GRS80!r}e0) AS e),
pts AS (SELECT event_id, (6060000 + event_id * 7919 % 40000) * 0.3048006096012192e0 - 2000000.0001016e0 AS x, top - ((1970000 + event_id * 104729 % 40000) * 0.3048006096012192e0 - 500000.0001016e0) AS y, n, f, e FROM events, f),
s AS (SELECT event_id, atan2(x, y) / n - radians(2.5) AS dl, (sqrt(x * x + y * y) / ({_A} * f)) ** (1 / n) AS t, e FROM pts),
it AS (SELECT event_id, dl, t, e, 0 AS i, pi() / 2 - 2 * atan(t) AS phi FROM s UNION ALL SELECT event_id, dl, t, e, i + 1, pi() / 2 - 2 * atan(t * ((1 - e * sin(phi)) / (1 + e * sin(phi))) ** (e / 2)) FROM it WHERE i < 7),
ll AS (SELECT event_id, degrees(phi) AS lat, degrees(dl) - 118.0 AS lon0, dl FROM it WHERE i = 7), {_UTM.split("), ", 1)[1].replace("lon + 123", "degrees(dl) + 5").replace("event_id, lon, lat,", "event_id,").replace(_E, f"{projection.GRS80!r}e0")}
SELECT event_id, round(e * 100)::BIGINT AS easting_cm, round(nn * 100)::BIGINT AS northing_cm FROM utm""")
def state_plane(spark, sf) -> DataFrame:
    e = F.col("event_id")
    feet = table(spark, sf, "events").select("event_id", (6060000 + e * 7919 % 40000).cast("double").alias("x"), (1970000 + e * 104729 % 40000).cast("double").alias("y"))
    return projection.state_plane_utm10(feet).select("event_id", F.round(F.col("easting") * 100).cast("bigint").alias("easting_cm"), F.round(F.col("northing") * 100).cast("bigint").alias("northing_cm"))


@query("sf4_foot_height", "SELECT * FROM (SELECT o_orderkey, CASE WHEN round(o_totalprice / 10 * 304.8006096012192) BETWEEN -1000000 AND 10000000 THEN round(o_totalprice / 10 * 304.8006096012192)::BIGINT END AS z_mm FROM orders) WHERE z_mm IS NOT NULL")
def foot_height(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", projection.foot_height(F.col("o_totalprice") / 10).alias("z_mm")).where("z_mm is not null")


@query("sf31_sf32_pixels", "SELECT event_id, floor((r * 54 + g * 183 + b * 19) / 256.0::DOUBLE + 0.5)::BIGINT AS luma, r + 256 * g + 65536 * b AS depth FROM (SELECT event_id, event_id * 7 % 256 AS r, event_id * 31 % 256 AS g, event_id * 101 % 256 AS b FROM events)")
def pixels(spark, sf) -> DataFrame:
    r, g, b = (F.col("event_id") * k % 256 for k in (7, 31, 101))
    return table(spark, sf, "events").select("event_id", display.luma(r, g, b).alias("luma"), display.unpacked_depth(r, g, b).alias("depth"))


@query("sf33_fingerprint", "SELECT o_orderkey, concat_ws(':', " + ", ".join(f"(o_orderkey * {k + 3} % {1000 + k})::VARCHAR" for k in range(13)) + ") AS fingerprint FROM orders")
def fingerprint(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", display.fingerprint(*[F.col("o_orderkey") * (k + 3) % (1000 + k) for k in range(13)]).alias("fingerprint"))


@query("sf34_redacted", "SELECT page_id, replace(regexp_replace(concat(url, CASE page_id % 3 WHEN 0 THEN '?key=abc&x=1' WHEN 1 THEN '?a=2&TOKEN=tok-1 then s3cret-literal' ELSE ' short' END), '([?&](?:key|token|api_key)=)[^&\\s]+', '\\1[REDACTED]', 'gi'), 's3cret-literal', '[REDACTED]') AS message FROM pages")
def redacted(spark, sf) -> DataFrame:
    tail = F.when(F.col("page_id") % 3 == 0, "?key=abc&x=1").when(F.col("page_id") % 3 == 1, "?a=2&TOKEN=tok-1 then s3cret-literal").otherwise(" short")
    return table(spark, sf, "pages").select("page_id", display.redacted(F.concat("url", tail), ["s3cret-literal", "short"]).alias("message"))


@query("sf35_cache", "SELECT c_custkey, w <= 640 OR coalesce(m, 8) <= 4 OR coarse AS small, CASE WHEN w <= 640 OR coalesce(m, 8) <= 4 OR coarse THEN 48 ELSE 128 END::BIGINT AS tiles FROM (SELECT c_custkey, c_custkey * 37 % 2000 AS w, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 16 END AS m, c_custkey % 11 = 0 AS coarse FROM customer)")
def cache(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    policy = display.cached_tiles(k * 37 % 2000, F.when(k % 3 == 0, k % 16), k % 11 == 0)
    return table(spark, sf, "customer").withColumn("p", policy).select("c_custkey", "p.small", "p.tiles")


@query("sf36_views", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'tower' WHEN event_id % 5 = 1 THEN 'quad' ELSE 'campus' END AS view, (event_id % 700) * 1000000 // 7623 AS x, (event_id % 300) * 1000000 // 7623 AS width FROM events")
def views(spark, sf) -> DataFrame:
    e = F.col("event_id")
    fragment = F.when(e % 5 == 0, "#view=tower").when(e % 5 == 1, "#zoom=2&view=quad").when(e % 5 == 2, "#view=moon").when(e % 5 == 3, "#review=tower").otherwise("")
    rect = display.crop(e % 700, e % 40, e % 300, e % 200, 7623)
    return table(spark, sf, "events").select("event_id", display.view_of(fragment, ["tower", "quad"], "campus").alias("view"), rect["x"].alias("x"), rect["width"].alias("width"))


@query("sf38_sf39_sf44_paths", "SELECT event_id, concat('canonical/', event_id % 9, '/', event_id % 70, '_', event_id % 50, '.idx') AS path, -500 + (event_id % 1000 + 500) * (event_id % 7) // 7 AS at, least(greatest(value / 20, 1 / 32.0::DOUBLE), 32.0::DOUBLE)::DOUBLE AS zoom FROM events")
def paths(spark, sf) -> DataFrame:
    e = F.col("event_id")
    long = lambda n: F.lit(n).cast("bigint")
    return table(spark, sf, "events").select("event_id", display.tile_path("canonical", e % 9, e % 70, e % 50, "idx").alias("path"), display.between(long(-500), e % 1000, e % 7, long(7)).alias("at"), display.zoom(F.col("value") / 20).alias("zoom"))


@query("sf43_resident", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id * 4) * 1024 WHEN 1 THEN event_id * 4096 END::BIGINT AS bytes FROM events")
def resident(spark, sf) -> DataFrame:
    e = F.col("event_id")
    text = F.when(e % 3 == 0, F.concat(F.lit("\tMaximum resident set size (kbytes): "), (e * 4).cast("string"), F.lit("\n"))).when(e % 3 == 1, F.concat(F.lit("  "), (e * 4096).cast("string"), F.lit("  maximum resident set size"))).otherwise("none")
    return table(spark, sf, "events").select("event_id", display.resident_bytes(text).alias("bytes"))
