"""JSON documents held against contracts: typed fields of VARIANT values, and one stable code for what is wrong first.

A document is parsed once into a VARIANT. Fields keep the types they were written with, so a number in quotes, a
fraction or a missing field is a code and not a null. Arrays of a document are explored in its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.durable import written
from loamgrid.functions.intmath import let
from loamgrid.operators.geometry import doubled_area, first_broken

SAFE_INTEGER = 2**53 - 1
#: Names that documents give themselves: schemas and how styles begin. They are defaults of parameters, for documents of any
#: make state their own.
FIXTURE, RELEASE, CAPTURE, STYLES = "world-fixture/v1", "release/v1", "capture/v1", "v1."
#: The coordinate system and the licence of worlds; classes; reviews that need a note.
CRS, LICENSE, EPSG = "local integer millimeters derived from EPSG:26910", "CC-BY-4.0", 26_910
CLASSES = ["terrain", "water", "road", "path", "athletic-surface", "parking", "building", "vegetation", "unknown"]
NOTED = ["accepted-override", "unreviewed-conflict"]
#: Limits of an origin in mm, and of a capture's numbers.
EASTING, NORTHING, ELEVATION = (100_000_000, 900_000_000), (0, 10_000_000_000), (-1_000_000, 10_000_000)
PROVIDERS, PIXELS = ["synthetic", "google-photorealistic-3d-tiles"], 4_096
SHA256 = "^[0-9a-f]{64}$"
COUNTS = ("width", "height", "tile_count", "encoded_bytes")


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column, path: str) -> Column:
    """BIGINT, DECIMAL(..), DOUBLE, STRING, BOOLEAN, VOID, OBJECT<..> or ARRAY<..> of a field; null if there is none."""
    return F.schema_of_variant(at(v, path))


def is_integer(v: Column, path: str, low: int, high: int) -> Column:
    value = F.when(kind(v, path) == "BIGINT", F.try_variant_get(v, path, "bigint"))
    return F.coalesce(value.between(low, high), F.lit(False))


def is_text(v: Column, path: str, pattern: str = ".") -> Column:
    return F.coalesce((kind(v, path) == "STRING") & F.try_variant_get(v, path, "string").rlike(pattern), F.lit(False))


def is_value(v: Column, path: str, value: str | bool | int) -> Column:
    type_ = "BOOLEAN" if isinstance(value, bool) else "BIGINT" if isinstance(value, int) else "STRING"
    return F.coalesce((kind(v, path) == type_) & (F.try_variant_get(v, path, type_.lower()) == value), F.lit(False))


def is_object(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "map<string,variant>").isNotNull()


def items(v: Column, path: str) -> Column:
    """An array field as array<variant>; null for anything else."""
    return F.try_variant_get(v, path, "array<variant>")


def number(v: Column, path: str) -> Column:
    """An integer field as BIGINT; null for anything else."""
    return F.when(kind(v, path) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def text(v: Column, path: str) -> Column:
    return F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def first_code(rules: dict[str, Column]) -> Column:
    """The code of the first rule that does not hold, or cannot be answered; null if all hold."""
    return first_broken({code: F.coalesce(ok, F.lit(False)) for code, ok in rules.items()})


def once(code: Column) -> Column:
    """code out of an array: a test of it stays where it is, instead of working it out a second time, before rows are dealt out."""
    return F.explode(F.array(code))


def ring_code(ring: Column) -> Column:
    """The first code of a ring, a variant: invalid_ring, invalid_point, open_ring or zero_area; null if it is whole."""
    three = lambda p: F.coalesce(F.size(items(p, "$")) == 3, F.lit(False)) & (kind(p, "$[0]") == "BIGINT") & (kind(p, "$[1]") == "BIGINT") & (kind(p, "$[2]") == "BIGINT")
    flat = lambda points: F.transform(points, lambda p: F.struct(number(p, "$[0]").alias("x"), number(p, "$[1]").alias("y"), number(p, "$[2]").alias("z")))
    code = lambda points, flat: first_code({"invalid_ring": F.size(points) >= 4, "invalid_point": F.forall(points, lambda p: F.coalesce(three(p), F.lit(False))), "open_ring": flat[0] == F.element_at(flat, -1), "zero_area": doubled_area(flat) != 0})
    return let(items(ring, "$"), lambda points: let(flat(points), lambda f: code(points, f)))


def polygon_code(rings: Column) -> Column:
    """The first code of a polygon's rings, an array of variants."""
    return F.get(F.filter(F.transform(rings, ring_code), lambda c: c.isNotNull()), F.lit(0))


def geometry_code(v: Column) -> Column:
    """The first code of a feature's geometry, a variant; null if it is whole."""
    rings, polygons = items(v, "$.rings"), items(v, "$.polygons")
    some = lambda a: F.coalesce(F.size(a) > 0, F.lit(False))
    part = lambda p: F.when(some(items(p, "$.rings")), polygon_code(items(p, "$.rings"))).otherwise("invalid_polygon")
    several = F.get(F.filter(F.transform(polygons, part), lambda c: c.isNotNull()), F.lit(0))
    return (
        F.when(~is_object(v), "invalid_geometry").when(is_value(v, "$.type", "polygon"), F.when(some(rings), polygon_code(rings)).otherwise("invalid_polygon"))
        .when(is_value(v, "$.type", "multipolygon"), F.when(some(polygons), several).otherwise("invalid_multipolygon")).otherwise("invalid_geometry_type")
    )


def origin_code(epsg: Column, easting: Column, northing: Column, elevation: Column) -> Column:
    """'origin' if a world's origin lies outside the limits of its projection, or is not whole; else null."""
    ok = (epsg == EPSG) & easting.between(*EASTING) & northing.between(*NORTHING) & elevation.between(*ELEVATION)
    return F.when(~F.coalesce(ok, F.lit(False)), "origin")


def fixtures(docs: DataFrame, key: str = "id", json: str = "json", schema: str = FIXTURE) -> DataFrame:
    """key, place and code of the first thing wrong with each document, or, if nothing is wrong with the whole, with each feature.

    place is null for the document and the number of the feature (from 0) for features. Text that is no JSON, and JSON that
    is no object, are 'invalid_root'. Features of one document are seen in its row.
    """
    d = docs.select(F.col(key), F.try_parse_json(F.col(json)).alias("v"))
    v = F.col("v")
    whole = lambda v: is_value(v, "$.schema", schema)
    sources = items(v, "$.sources")
    named = F.filter(sources, lambda s: is_object(s) & is_text(s, "$.id", "") & is_text(s, "$.license", "") & is_text(s, "$.attribution", ""))
    known = F.array_distinct(F.transform(named, lambda s: text(s, "$.id")))
    d = d.withColumns({"_known": known, "_features": items(v, "$.features")})
    document = lambda v: first_code({
        "invalid_root": is_object(v), "invalid_license": is_value(v, "$.license", LICENSE), "source_pixels": is_value(v, "$.contains_source_pixels", False), "transients": is_value(v, "$.contains_transients", False),
        "invalid_crs": ~whole(v) | is_value(v, "$.crs", CRS), "invalid_origin": ~whole(v) | (is_value(v, "$.origin.epsg", EPSG) & (kind(v, "$.origin.easting_mm") == "BIGINT") & (kind(v, "$.origin.northing_mm") == "BIGINT") & (kind(v, "$.origin.elevation_mm") == "BIGINT")),
        "invalid_sources": sources.isNotNull(), "invalid_source": F.size("_known") == F.size(sources), "invalid_features": F.size("_features") > 0,
    })
    d = d.withColumn("_code", once(let(F.struct("v"), lambda s: document(s["v"]))))
    ids = F.transform("_features", lambda f: number(f, "$.id"))
    d = d.withColumns({"_ids": ids})
    each = d.where("_code is null").select(key, "_known", "_ids", F.posexplode_outer("_features").alias("place", "f")).where("f is not null")
    each = each.withColumn("code", once(let(F.struct("f"), lambda s: feature_code(s["f"], F.col("_known"), F.col("_ids"), F.col("place")))))
    featured = each.where("code is not null").select(key, F.col("place").cast("bigint").alias("place"), "code")
    return d.where("_code is not null").select(key, F.lit(None).cast("bigint").alias("place"), F.col("_code").alias("code")).unionByName(featured)


def feature_code(f: Column, known: Column, ids: Column, place: Column) -> Column:
    """The first code of a feature, a variant, among the known sources and ids of its document."""
    n = number(f, "$.id")
    refs, parent = items(f, "$.source_ids"), at(f, "$.parent_id")
    review = F.coalesce(text(f, "$.review").isin(NOTED), F.lit(False))
    geometry = geometry_code(at(f, "$.geometry"))
    broken = first_code({
        "invalid_feature": is_object(f), "invalid_id": (n > 0) & (F.array_position(ids, n) == place + 1), "invalid_class": text(f, "$.class").isin(CLASSES), "invalid_confidence": is_integer(f, "$.confidence_bp", 0, 10_000),
        "missing_source": F.size(refs) > 0, "unknown_source": F.forall(refs, lambda r: F.coalesce(F.array_contains(known, text(r, "$")), F.lit(False))), "missing_review_note": ~review | is_text(f, "$.review_note"),
    })
    orphan = F.when(parent.isNotNull() & ~F.is_variant_null(parent) & ~F.coalesce(F.array_contains(ids, number(f, "$.parent_id")), F.lit(False)), "unknown_parent")
    return F.coalesce(broken, geometry, orphan)


def worlds(docs: DataFrame, key: str = "id", json: str = "json", schema: str = FIXTURE) -> DataFrame:
    """The features of documents that fixtures() finds whole: key, id, class, name, height_mm, confidence_bp, source_ids, parent_id and
    parts, polygons of rings of points x, y, z. Documents with a code, of their own or of a feature, give nothing."""
    good = docs.join(fixtures(docs, key, json, schema).select(key).distinct(), key, "left_anti")
    f = good.select(F.col(key), F.explode_outer(items(F.try_parse_json(F.col(json)), "$.features")).alias("f")).where("f is not null")
    v = F.col("f")
    point = lambda p: F.struct(*[number(p, f"$[{i}]").alias(c) for i, c in enumerate("xyz")])
    rings = lambda r: F.transform(r, lambda ring: F.transform(items(ring, "$"), point))
    parts = F.when(is_value(v, "$.geometry.type", "polygon"), F.array(rings(items(v, "$.geometry.rings")))).otherwise(F.transform(items(v, "$.geometry.polygons"), lambda p: rings(items(p, "$.rings"))))
    names = F.transform(items(v, "$.source_ids"), lambda s: text(s, "$"))
    return f.select(key, number(v, "$.id").alias("feature_id"), text(v, "$.class").alias("class"), text(v, "$.name").alias("name"), F.coalesce(number(v, "$.height_mm"), F.lit(0).cast("bigint")).alias("height_mm"), number(v, "$.confidence_bp").alias("confidence_bp"), names.alias("source_ids"), number(v, "$.parent_id").alias("parent_id"), parts.alias("parts"))


#: What an evidence artifact calls itself, by default.
EVIDENCE = {"schema": "perception-evidence/v1", "region_id": "hero-v1", "status": "compiled-prototype-evidence", "compiler": "naip-lidar-consensus-v1"}
#: Its grid, digests, cells of the grid and points of a chunk.
GRID = {"crs": CRS, "origin_easting_mm": 573_200_000, "origin_northing_mm": 4_142_200_000, "min_x_mm": 43_583, "min_y_mm": 86_784, "cell_size_mm": 20_000, "columns": 31, "rows": 31}
DIGESTS, CELLS, CHUNK = 5, 961, 250_000


def evidence_code(v: Column, names: dict[str, str]) -> Column:
    """The first code of an evidence artifact, a variant: root, policy, provenance or accounting; cells are evidence_cells()."""
    digests = F.try_variant_get(v, "$.source_sha256", "map<string,variant>")
    cells = items(v, "$.cells")
    return first_code({
        "root": is_object(v), "policy": F.array_min(F.array(*[is_value(v, f"$.{k}", x) for k, x in names.items()], is_value(v, "$.contains_source_pixels", False), is_value(v, "$.contains_transients", False), *[is_value(v, f"$.grid.{k}", x) for k, x in GRID.items()])),
        "provenance": (F.size(digests) == DIGESTS) & F.forall(F.map_entries(digests), lambda e: (e["key"] != "") & F.coalesce(text(e["value"], "$").rlike(SHA256), F.lit(False))),
        "accounting": (number(v, "$.vector_masked_cell_count") + number(v, "$.evidence_cell_count") == CELLS) & (number(v, "$.evidence_cell_count") == F.size(cells)) & is_value(v, "$.lidar_chunk_points", CHUNK),
    })


def evidence(docs: DataFrame, key: str = "id", json: str = "json", names: dict[str, str] = EVIDENCE) -> DataFrame:
    """key and code of the first thing wrong with the whole of each evidence artifact."""
    d = docs.select(F.col(key), F.try_parse_json(F.col(json)).alias("v"))
    return d.select(key, once(let(F.struct("v"), lambda s: evidence_code(s["v"], names))).alias("code")).where("code is not null")


def evidence_cells(docs: DataFrame, key: str = "id", json: str = "json", names: dict[str, str] = EVIDENCE) -> DataFrame:
    """The cells of artifacts whose whole is right: key, position and the fields of checks.evidence_cells(), which judges them."""
    good = docs.join(evidence(docs, key, json, names).select(key), key, "left_anti")
    c = good.select(F.col(key), F.posexplode_outer(items(F.try_parse_json(F.col(json)), "$.cells")).alias("position", "c")).where("c is not null")
    v = F.col("c")
    fields = {"col": "index.column", "row": "index.row", "height_mm": "height_mm", "confidence_bp": "confidence_bp", "samples": "naip_sample_count", "green_bp": "naip_green_fraction_bp", "vegetation_bp": "lidar_vegetation_fraction_bp", "building_bp": "lidar_building_fraction_bp", "transient_points": "transient_masked_points"}
    return c.select(key, F.col("position").cast("bigint").alias("position"), text(v, "$.class").alias("class"), text(v, "$.material").alias("material"), *[number(v, f"$.{path}").alias(name) for name, path in fields.items()], F.transform(items(v, "$.source_ids"), lambda s: text(s, "$")).alias("source_ids"))


def captures(docs: DataFrame, key: str = "id", json: str = "json", schema: str = CAPTURE) -> DataFrame:
    """key and code of the first thing wrong with each capture request: object, identity, tile, camera, span, lighting or readiness."""
    d = docs.select(F.col(key), F.try_parse_json(F.col(json)).alias("v"))
    return d.select(key, once(let(F.col("v"), lambda x: capture_code(x, schema))).alias("code")).where("code is not null")


def capture_code(v: Column, schema: str) -> Column:
    """The first code of a capture request, a variant."""
    span = lambda side: number(v, f"$.tile.{side}") + 2 * number(v, "$.tile.guardPx")
    between = lambda group, fields: [is_integer(v, f"$.{group}.{f}", low, high) for f, (low, high) in fields.items()]
    every = lambda rules: F.coalesce(F.array_min(F.array(*rules)), F.lit(False))
    identifier = "^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
    near, far = number(v, "$.camera.nearMm"), number(v, "$.camera.farMm")
    tile = {"column": (-1_000_000, 1_000_000), "row": (-1_000_000, 1_000_000), "coreWidthPx": (1, 3_584), "coreHeightPx": (1, 3_584), "guardPx": (1, 1_024), "millimetersPerPixel": (1, 100_000), "centerLongitudeE7": (-1_800_000_000, 1_800_000_000), "centerLatitudeE7": (-900_000_000, 900_000_000)}
    camera = {"azimuthMillidegrees": (0, 359_999), "elevationMillidegrees": (1_000, 89_999), "targetAltitudeMm": (-SAFE_INTEGER, SAFE_INTEGER), "nearMm": (1, SAFE_INTEGER), "farMm": (1, SAFE_INTEGER), "cameraDistanceMm": (1, SAFE_INTEGER)}
    readiness = {"timeoutMs": (1_000, 300_000), "stableFrames": (2, 600), "stableDurationMs": (100, 30_000), "minimumVisibleTiles": (1, 100_000)}
    mm = number(v, "$.tile.millimetersPerPixel")
    rules = {
        "object": is_object(v),
        "identity": every([is_value(v, "$.schema", schema), is_text(v, "$.bundleId", identifier), F.coalesce(text(v, "$.provider").isin(PROVIDERS), F.lit(False)), is_text(v, "$.sourceEpoch"), *[at(v, f"$.{g}").isNotNull() for g in ("tile", "camera", "lighting", "readiness")]]),
        "tile": every([is_text(v, "$.tile.regionId", identifier), *between("tile", tile), F.coalesce((span("coreWidthPx") <= PIXELS) & (span("coreHeightPx") <= PIXELS), F.lit(False))]),
        "camera": every([is_value(v, "$.camera.projection", "orthographic"), *between("camera", camera), F.coalesce((far > near) & (number(v, "$.camera.cameraDistanceMm") > near) & (number(v, "$.camera.cameraDistanceMm") < far), F.lit(False))]),
        "span": (number(v, "$.camera.orthographicWidthMm") == span("coreWidthPx") * mm) & (number(v, "$.camera.orthographicHeightMm") == span("coreHeightPx") * mm),
        "lighting": every(between("lighting", {"sunAzimuthMillidegrees": (0, 359_999), "sunElevationMillidegrees": (1_000, 89_999)})), "readiness": every(between("readiness", readiness)),
    }
    return first_code(rules)


def releases(docs: DataFrame, key: str = "id", json: str = "json", schema: str = RELEASE, styles: str = STYLES) -> DataFrame:
    """key, valid, and of valid release documents style_id, style_sha256, world_sha256, width, height, tile_count, encoded_bytes and
    tile_set_sha256: what a page may show of a release. A document that claims to be qualified is not valid."""
    d = docs.select(F.col(key), F.try_parse_json(F.col(json)).alias("v"))
    v = F.col("v")
    d = d.withColumn("valid", let(v, lambda x: F.array_min(F.array(*release_rules(x, schema, styles)))))
    shown = lambda c: F.when(F.col("valid"), c)
    return d.select(key, "valid", *[shown(text(v, f"$.{c}")).alias(c) for c in ("style_id", "style_sha256", "world_sha256")], *[shown(number(v, f"$.dzi.{c}")).alias(c) for c in COUNTS], shown(text(v, "$.dzi.tile_set_sha256")).alias("tile_set_sha256"))


def release_rules(v: Column, schema: str, styles: str) -> list[Column]:
    return [is_value(v, "$.schema", schema), is_value(v, "$.status", "artifact-candidate"), is_value(v, "$.qualified", False), F.coalesce(text(v, "$.style_id").startswith(styles), F.lit(False)), is_text(v, "$.style_sha256", SHA256), is_text(v, "$.world_sha256", SHA256), is_value(v, "$.dzi.descriptor", "hero.dzi"), is_value(v, "$.dzi.format", "webp"), is_value(v, "$.dzi.tile_size", 512), is_value(v, "$.dzi.overlap", 0), *[is_integer(v, f"$.dzi.{c}", 1, SAFE_INTEGER) for c in COUNTS], is_text(v, "$.dzi.tile_set_sha256", SHA256)]


#: Rounds whose tables are read one by one before they are put together.
ROUNDS = 16


def packed(digest: Column) -> Column:
    """The bytes of a digest: half as many as letters where it is small hex, all of its own otherwise; different for different digests."""
    small = F.when((F.lower(digest) == digest) & (F.length(digest) % 2 == 0), F.concat(F.unhex(F.lit("00")), F.unhex(digest)))
    return F.coalesce(small, F.concat(F.unhex(F.lit("01")), digest.cast("binary")))


def chains(documents: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """chain, path and problem of documents that do not hang together by digests; each problem of a path once.

    documents: chain, path, sha256, of what is there. links: chain, path, target, sha256, what a document at path says of
    another. roots: chain, path. 'missing' targets, 'altered' ones, whose digest is another than stated by any link, and
    'orphan' documents, which no way over links from a root reaches. Digests are shuffled once, where links meet documents;
    what is kept of that is keys only. Reachability goes in rounds over links to documents that are there, one link a round,
    and writes each document that is reached once, and again every ROUNDS rounds.
    """
    key = ["chain", "path"]
    none = F.lit(None).cast(links.schema["path"].dataType)
    stated = links.select("chain", F.col("path").alias("source"), F.col("target").alias("path"), packed(F.col("sha256")).alias("_stated"))
    stated = stated.unionByName(roots.select("chain", none.alias("source"), "path", F.lit(None).cast("binary").alias("_stated")))
    held = stated.join(documents.select(*key, packed(F.col("sha256")).alias("_held"), F.lit(True).alias("_there")), key, "left")
    problem = F.when(F.col("_held").isNull(), "missing").when(F.col("_stated") != F.col("_held"), "altered")
    judged = written(held.select("chain", "source", "path", problem.alias("problem"), F.col("_there").isNotNull().alias("there")), "judged")
    wrong = judged.where("problem is not null").select(*key, "problem").distinct()
    steps = judged.where("there and source is not null").select("chain", "source", "path")
    new = written(judged.where("there and source is null").select(*key).distinct(), "reached")
    seen, rounds = new, 0
    while new.limit(1).count():
        further = new.withColumnRenamed("path", "source").join(steps, ["chain", "source"]).select(*key).distinct().join(seen, key, "left_anti")
        new = written(further, "reached")
        seen, rounds = seen.unionByName(new), rounds + 1
        if rounds % ROUNDS == 0:
            seen = written(seen, "seen")
    return wrong.unionByName(documents.select(*key).join(seen, key, "left_anti").select(*key, F.lit("orphan").alias("problem")))
