"""Rules of manifests, styles, releases and responses, as violations; and small reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions.intmath import div
from loamgrid.operators.checks import digest, violations

#: Evidence bits that exist, classes of the mask, and the most colours, sides and layers of images.
EVIDENCE_BITS, CLASSES, COLOURS, SIDE = 0xFF, 24, 128, 16_384
#: An accepted capture's coverage in hundredths of a percent.
COVERAGE = (9_950, 10_000)


def identifier(c: Column, most: int) -> Column:
    """Whether a text is made of small letters, digits and hyphens only, and neither empty nor too long."""
    return c.rlike(f"^[a-z0-9-]{{1,{most}}}$")


def plain_text(c: Column, most: int) -> Column:
    """Whether a text is neither blank nor longer in bytes than most, has no control characters and no way up a folder."""
    return (F.length(F.trim(c)) > 0) & (F.octet_length(c) <= most) & ~c.rlike(r"[\x00-\x1F\x7F]") & ~F.contains(c, F.lit("../"))


def known_flags(c: Column) -> Column:
    return c.bitwiseAND(~EVIDENCE_BITS & 0xFFFF) == 0


def contains_flags(c: Column, flags: int) -> Column:
    return c.bitwiseAND(flags) == flags


def reference_manifests(manifests: DataFrame) -> DataFrame:
    """The broken rules of capture manifests: span of pixels, guard, coverage, layer digests and the order of layers."""
    total = F.col("core_px") + 2 * F.col("guard_px")
    layers = F.col("layers")
    return violations(manifests, F.col("id"), {
        "side": total.between(1, 4096), "guard": F.col("guard_px").between(0, 512), "span": F.col("span_mm") == total * F.col("mm_per_px"), "coverage": F.col("coverage_bp").between(*COVERAGE),
        "layers": F.transform(layers, lambda x: x["name"]) == F.col("required"), "digests": ~F.exists(layers, lambda x: ~digest(x["sha256"])),
    })


def styles(packs: DataFrame) -> DataFrame:
    """The broken rules of style packs: 1 to 128 colours, indices within them, positive measures, heights in order."""
    size = F.col("colours")
    return violations(packs, F.col("id"), {"palette": size.between(1, COLOURS), "index": ~F.exists("indices", lambda i: ~i.between(0, size - 1)), "measures": ~F.exists("measures", lambda m: m <= 0), "heights": F.col("low_mm") < F.col("high_mm")})


def images(headers: DataFrame) -> DataFrame:
    """The broken rules of indexed images: sides, colours, length of the pixels and the largest index."""
    w, h = F.col("width"), F.col("height")
    return violations(headers, F.col("id"), {"side": w.between(1, SIDE) & h.between(1, SIDE), "palette": F.col("colours").between(1, COLOURS), "length": F.col("length") == w * h, "index": F.col("largest") < F.col("colours")})


def mask_counts(stated: DataFrame, pixels: DataFrame) -> DataFrame:
    """class, stated and observed where a mask manifest's counts and its pixels differ; classes on one side only count 0."""
    seen = pixels.groupBy("class").agg(F.count("*").alias("observed"))
    both = stated.join(seen, "class", "full_outer").select("class", F.coalesce("stated", F.lit(0)).alias("stated"), F.coalesce("observed", F.lit(0)).alias("observed"))
    return both.where("stated <> observed")


def mask_pixels(pixels: DataFrame, key: str) -> DataFrame:
    """The broken rules of mask pixels: class, confidence, evidence bits, and no instance without a class."""
    return violations(pixels, F.col(key), {"class": F.col("class").between(0, CLASSES - 1), "confidence": F.col("confidence").between(0, 255), "evidence": known_flags(F.col("evidence")), "instance": (F.col("instance") == 0) | (F.col("class") > 0)})


def releases(tiles: DataFrame, side: int = 512) -> DataFrame:
    """The broken rules of release tiles (release_id, position, level, col, row, width, height, digest, bytes)."""
    key = F.struct("level", "row", "col")
    last = F.lag(key).over(Window.partitionBy("release_id").orderBy("position"))
    ordered = tiles.withColumn("_up", last.isNull() | (last < key))
    sides = F.col("width").between(1, side) & F.col("height").between(1, side)
    return violations(ordered, F.concat_ws(":", F.col("release_id").cast("string"), F.col("position").cast("string")), {"order": F.col("_up"), "side": sides, "digest": digest(F.col("digest")), "bytes": F.col("bytes") > 0})


def landmarks(objects: DataFrame, names: list[str]) -> DataFrame:
    """world_id and the names that none of its objects has, in order."""
    found = objects.groupBy("world_id").agg(F.collect_set(F.when(F.col("name").isin(names), F.col("name"))).alias("_n"))  # len(names) at most
    return found.select("world_id", F.array_except(F.array(*[F.lit(n) for n in names]), "_n").alias("missing")).where(F.size("missing") > 0)


def responses(log: DataFrame) -> DataFrame:
    """id and problem of answers to a resumed fetch: the tag must be the locked one; from 0 the status is 200, else 206 with
    the whole range from the offset on."""
    offset, size = F.col("offset"), F.col("size")
    wanted = F.format_string("bytes %d-%d/%d", offset, size - 1, size)
    wrong = F.when(F.col("locked_etag").isNotNull() & ~F.col("etag").eqNullSafe(F.col("locked_etag")), "etag").when((offset == 0) & (F.col("status") != 200), "status").when((offset > 0) & (F.col("status") != 206), "status")
    return log.select("id", wrong.when((offset > 0) & ~F.col("range").eqNullSafe(wanted), "range").alias("problem")).where("problem is not null")


def gates(runs: DataFrame, tiles_per_minute: int, seconds: int, megabytes: int) -> DataFrame:
    """id, rate (tiles of the largest level a minute, by its slowest run) and whether all runs pass all gates."""
    rate = div(F.col("tiles") * 60_000, F.col("millis"))
    return runs.groupBy("id").agg(F.min(rate).alias("rate"), F.bool_and((rate >= tiles_per_minute) & (F.col("millis") <= seconds * 1000) & (F.col("rss_mb") <= megabytes)).alias("passed"))


def sync_report(records: DataFrame) -> DataFrame:
    """lock_id, counts of cached and fetched records, their bytes, and a line for each record in the order of ids,
    then of bytes, as numbers."""
    line = F.concat_ws(" ", "id", F.when(F.col("cached"), "cached").otherwise("fetched"), F.col("bytes").cast("string"))
    lines = F.array_sort(F.collect_list(F.struct("id", "bytes", line.alias("line"))))  # the records of one lock
    out = records.groupBy("lock_id").agg(F.count_if("cached").alias("cached"), F.count_if(~F.col("cached")).alias("fetched"), F.sum("bytes").alias("bytes"), lines.alias("_l"))
    return out.select("lock_id", "cached", "fetched", "bytes", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("report"))


def scene_vertex(x: Column, y: Column, z: Column, layer: Column, scale: int, step: int, rise: int) -> Column:
    """struct(x, y, depth): the 2:1 projection in subpixels and the depth by which triangles cover each other."""
    flat = div(div((x + y) * scale, step), 2)
    return F.struct(div((x - y) * scale, step).alias("x"), (flat - div(z * scale, rise)).alias("y"), ((x + y + z) * 16 + layer).alias("depth"))


def projected_box(min_x: Column, min_y: Column, min_z: Column, max_x: Column, max_y: Column, max_z: Column, scale: int, step: int, rise: int) -> Column:
    """The box of a world box's eight corners on the screen, by the corners that lie outermost."""
    at = lambda x, y, z: scene_vertex(x, y, z, F.lit(0), scale, step, rise)
    return F.struct(at(min_x, max_y, min_z)["x"].alias("min_x"), at(min_x, min_y, max_z)["y"].alias("min_y"), at(max_x, min_y, min_z)["x"].alias("max_x"), at(max_x, max_y, min_z)["y"].alias("max_y"))


def capped(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first so many rows of every key, in order: a cap that is part of what is asked for."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
