"""What stands between the operators and their inputs and outputs: registrations, contracts of layers, options, viewports, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.display import redacted
from loamgrid.functions.intmath import div
from loamgrid.operators.checks import digest, violations

#: Layers of a reference bundle with file, encoding, PNG colour type and whether they carry their own digest;
#: roles of artifacts; the only published tile side and scale; names of a review and its exact size.
LAYERS = {"color": ("color.png", "png-rgba8"), "whitebox": ("whitebox.png", "png-rgba8"), "linear-depth": ("depth.bin", "raw-u32le-millimeters"), "view-normal": ("normal.png", "png-rgba8"), "fixed-shadow": ("fixed-shadow.png", "png-gray8"), "coverage": ("coverage.png", "png-gray8")}
ROLES = ["evidence", "repair-input", "persistent"]
TILE, HALF_STEP = 512, 250
#: Provenance of the imagery and the point clouds.
_USGS = ("USGS public domain without use restrictions", "USGS 3D Elevation Program")
PERCEPTION = [("naip-2024-hero", "USDA public data with FPAC-BC derived-product credit requested", "Imagery: USDA FPAC-BC GEO, NAIP 2024")] + [(f"usgs-lidar-0{tile}", *_USGS) for tile in (7509800, 7509825, 7759800, 7759825)]
#: Sides of the evidence grid's cells, and its coordinate system.
CELL, CRS = 20_000, "local integer millimeters derived from EPSG:26910"


def with_perception(sources: DataFrame) -> DataFrame:
    """sources (id, license, attribution) with the rows of the perception evidence; a source that is there already stays as it is."""
    fixed = sources.sparkSession.createDataFrame(PERCEPTION, "id string, license string, attribution string")
    return sources.select("id", "license", "attribution").unionByName(fixed.join(sources.select("id"), "id", "left_anti"))


def layer_rules(layers: DataFrame) -> DataFrame:
    """The broken rules of layers (bundle, kind, path, encoding, width, height, total_width, total_height): a known kind, its file
    and encoding, and the guarded size of the tile."""
    contract = F.create_map(*[x for kind, (file, encoding) in LAYERS.items() for x in (F.lit(kind), F.struct(F.lit(file).alias("path"), F.lit(encoding).alias("encoding")))])
    wanted = layers.withColumn("_c", F.element_at(contract, F.col("kind")))
    return violations(wanted, F.concat_ws(":", F.col("bundle").cast("string"), "kind"), {"kind": F.col("_c").isNotNull(), "path": F.col("path") == F.col("_c.path"), "encoding": F.col("encoding") == F.col("_c.encoding"), "grid": (F.col("width") == F.col("total_width")) & (F.col("height") == F.col("total_height"))})


def registrations(manifests: DataFrame) -> DataFrame:
    """How masks are registered with reference manifests (bundle_id, region_id, core_width, core_height, guard, grid_json, manifest_json):
    bundle_id, region_id, the guarded width and height, and the digests of the whole manifest and of its tile and camera."""
    return manifests.select("bundle_id", F.sha2("manifest_json", 256).alias("manifest_sha256"), "region_id", (F.col("core_width") + 2 * F.col("guard")).alias("width_px"), (F.col("core_height") + 2 * F.col("guard")).alias("height_px"), F.sha2("grid_json", 256).alias("grid_sha256"))


def publish_options(runs: DataFrame) -> DataFrame:
    """The broken rules of publications (id, world_sha256, style_sha256, tile_size, half_step): digests, and the one published size and scale."""
    return violations(runs, F.col("id"), {"world": digest(F.col("world_sha256")), "style": digest(F.col("style_sha256")), "tile": F.col("tile_size") == TILE, "scale": F.col("half_step") == HALF_STEP})


def viewport(offset_x: Column, offset_y: Column, origin_x: Column, origin_y: Column, subpixels: int = 256) -> Column:
    """struct(offset_x, offset_y): the offsets of a region whose first pixel is at an origin of the layout."""
    return F.struct((offset_x - origin_x * subpixels).alias("offset_x"), (offset_y - origin_y * subpixels).alias("offset_y"))


def grid_size(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """struct(columns, rows) of the cells that cover a box."""
    n = lambda low, high: div(high - low + (CELL - 1), CELL)
    return F.struct(n(min_x, max_x).alias("columns"), n(min_y, max_y).alias("rows"))


def guard(shadow_x: Column, shadow_y: Column, radius: Column, height: Column, step: Column, rise: Column) -> Column:
    """Pixels by which what a style draws may leave an object's box: render.required_guard() for many styles."""
    from loamgrid.operators.render import CROWN_SPREAD, SUBPIXELS

    r, zero = radius + CROWN_SPREAD, F.lit(0).cast("bigint")
    points = [(shadow_x, shadow_y, zero), (r, -r, zero), (-r, r, zero), (r, r, height), (-r, -r, height)]
    sides = [v for x, y, z in points for v in (div((x - y) * SUBPIXELS, step), div(div((x + y) * SUBPIXELS, step), 2) - div(z * SUBPIXELS, rise))]
    return div(F.greatest(*[F.abs(v) for v in sides]) + SUBPIXELS - 1, F.lit(SUBPIXELS)) + 2


def failure_message(source_id: Column, stage: Column, attempts: Column, detail: Column) -> Column:
    """What may be shown of a failed acquisition: source, stage and attempts, and the detail without addresses and keys."""
    clean = F.regexp_replace(redacted(detail, []), r"[A-Za-z][A-Za-z0-9+.-]*://\S+", "[address]")
    return F.format_string("source %s failed at %s after %d attempts: %s", source_id, stage, attempts, clean)


def features_json(objects: DataFrame) -> DataFrame:
    """id and json: an object as an output feature, its fields in their fixed order, without those that are null."""
    order = ["id", "name", "class", "geometry", "height_mm", "floor_count", "roof", "material", "confidence_bp", "source_ids", "review", "review_note", "parent_id"]
    return objects.select("id", F.to_json(F.struct(*[c for c in order if c in objects.columns])).alias("json"))


def review_allowed(releases: DataFrame, exact: dict[str, str | int]) -> DataFrame:
    """id and allowed: whether a release is the very one that a review was made for, by all fields of exact."""
    same = None
    for column, value in exact.items():
        one = F.col(column).eqNullSafe(F.lit(value))
        same = one if same is None else same & one
    return releases.select("id", same.alias("allowed"))
