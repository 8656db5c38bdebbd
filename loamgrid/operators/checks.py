"""Validation: every broken rule is a row (check_id, key); no rows mean that the input is valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions.durable import written


def violations(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """rules: what must hold. A rule that is null counts as broken. One pass over df."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return df.select(key.cast("string").alias("key"), F.explode(broken).alias("check_id"))


def source_lock(records: DataFrame) -> DataFrame:
    """Records of a source lock: digest, size, unique id, safe file name, named licence."""
    per_id = records.withColumn("_n", F.count("*").over(Window.partitionBy("id")))
    return violations(per_id, F.col("id"), {
        "digest": F.col("sha256").rlike("^[0-9a-f]{64}$"), "size": F.col("size_bytes") > 0, "unique": F.col("_n") == 1,
        "filename": F.col("filename").rlike("^[A-Za-z0-9._-]{1,96}$") & ~F.col("filename").startswith("."), "licence": F.length(F.trim("license")) > 0,
    })


#: Hosts that are never fetched from, the longest name in bytes, and cells of the evidence grid.
BANNED, NAME, GRID_CELLS = ("google.", "googleapis."), 256, 961


def headers(docs: DataFrame, key: str, schema: str, region: str) -> DataFrame:
    """The broken rules of lock or world documents (doc with schema, region_id and sources)."""
    return violations(docs, F.col(key), {"schema": F.col("doc.schema") == schema, "region": F.col("doc.region_id") == region, "sources": F.size("doc.sources") > 0})


def digest(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def ascending(keys: list[str], within: str, position: str) -> Column:
    """Whether a row's keys lie above those of the row before it."""
    key = F.struct(*keys)
    last = F.lag(key).over(Window.partitionBy(within).orderBy(position))
    return last.isNull() | (last < key)


def lock_records(records: DataFrame, lock: str = "lock_id") -> DataFrame:
    """The broken rules of source-lock records (of sources.documents.lock_records() and a lock column)."""
    filled = lambda *cs: F.least(*[F.length(F.coalesce(F.col(c), F.lit(""))) for c in cs]) > 0
    url, etag, path, name = (F.col(c) for c in ("url", "etag", "path", "filename"))
    web = F.col("acquisition_kind") == "https"
    ordered = records.withColumn("_ascending", ascending(["id"], lock, "position"))
    return violations(ordered, F.concat_ws(":", F.col(lock).cast("string"), F.col("position").cast("string")), {
        "approved": F.col("approved"), "raw": ~F.col("raw_content_in_final_output"), "named": filled("id", "kind", "role"), "order": F.col("_ascending"), "size": F.col("size_bytes") > 0, "digest": digest(F.col("sha256")),
        "provenance": filled("release", "source_date", "acquired_at", "license", "attribution", "metadata_url"),
        "https": ~web | url.startswith("https://"), "host": ~web | ~(F.contains(url, F.lit(BANNED[0])) | F.contains(url, F.lit(BANNED[1]))),
        "etag": ~web | etag.isNull() | etag.rlike('^"[!-~]+"$'), "path": web | ~(path.startswith("/") | path.rlike("(^|/)[.][.](/|$)")),
        "filename": (F.length(name) > 0) & ~name.rlike(r"[/\\]"),
    })


def object_rules(objects: DataFrame) -> DataFrame:
    """The broken rules of world objects, each on its own row."""
    building = F.col("class") == "building"
    noted = F.coalesce(F.length(F.trim("review_note")) > 0, F.lit(False))
    sources = F.col("source_ids")
    return violations(objects, F.col("id"), {
        "name": F.col("name").isNull() | ((F.length(F.trim("name")) > 0) & (F.octet_length("name") <= NAME)), "provenance": F.size(sources) > 0,
        "source_order": F.array_sort(F.array_distinct(sources)) == sources, "parent": F.col("parent_id").isNull() | building, "floors": (F.col("floor_count").isNull() & F.col("roof").isNull()) | building,
        "no_floor": F.col("floor_count").isNull() | (F.col("floor_count") > 0), "unknown": (F.col("class") != "unknown") | (F.col("review") == "unreviewed-conflict"),
        "note": ~F.col("review").isin("accepted-override", "unreviewed-conflict") | noted,
    })


def parents(objects: DataFrame) -> DataFrame:
    """Broken rules of parents: 'duplicate' ids, 'unknown' parents, parents that are no 'building', and 'cycle'.

    A chain of parents ends after as many doublings of its steps as the number of objects has bits, or it is a cycle or
    leads into one.
    """
    twice = objects.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select("id", F.lit("duplicate").alias("check_id"))
    each = objects.select("id", "class", "parent_id").dropDuplicates(["id"])
    up = each.where("parent_id is not null").join(each.select(F.col("id").alias("parent_id"), F.col("class").alias("_class"), F.lit(True).alias("_there")), "parent_id", "left")
    wrong = up.select("id", F.when(F.col("_there").isNull(), "unknown").when(F.col("_class") != "building", "building").alias("check_id")).where("check_id is not null")
    left = written(up.where("_there").select("id", F.col("parent_id").alias("up")), "parents")
    for _ in range(max(1, each.count()).bit_length() + 1):
        left = written(left.join(left.select(F.col("id").alias("up"), F.col("up").alias("_next")), "up").select("id", F.col("_next").alias("up")), "parents")
    found = twice.unionByName(wrong).unionByName(left.select("id", F.lit("cycle").alias("check_id")))
    return found.select(F.col("id").cast("string").alias("key"), "check_id")


def evidence_cells(cells: DataFrame, artifact: str = "artifact_id") -> DataFrame:
    """The broken rules of evidence cells: address, order, samples, sources, shares, and nothing made up for unknown ones."""
    share = lambda *cs: F.greatest(*cs).between(0, 10_000)
    ordered = cells.withColumn("_ascending", ascending(["row", "col"], artifact, "position"))
    return violations(ordered, F.concat_ws(":", F.col(artifact).cast("string"), F.col("position").cast("string")), {
        "address": F.col("col").between(0, 30) & F.col("row").between(0, 30), "order": F.col("_ascending"), "samples": F.col("samples") > 0,
        "sources": (F.size("source_ids") > 0) & (F.array_sort(F.array_distinct("source_ids")) == F.col("source_ids")), "shares": share("confidence_bp", "green_bp", "vegetation_bp", "building_bp"),
        "unknown": (F.col("class") != "unknown") | (F.col("material").isNull() & (F.col("height_mm") == 0)),
    })


def accounted(cells: DataFrame, artifact: str = "artifact_id") -> DataFrame:
    """artifact, masked (cells of the grid without evidence), eligible, and whole: whether the two make up the grid."""
    n = cells.groupBy(artifact).agg(F.countDistinct("col", "row").alias("eligible"), F.count("*").alias("_n"))
    return n.select(artifact, (GRID_CELLS - F.col("eligible")).alias("masked"), "eligible", ((F.col("_n") == F.col("eligible")) & F.col("eligible").between(1, GRID_CELLS - 1)).alias("whole"))


def qualified(objects: DataFrame, world: str = "world_id") -> DataFrame:
    """The broken rules of worlds ready for use: ids ascend, no object is unknown."""
    ordered = objects.withColumn("_ascending", ascending(["id"], world, "position"))
    return violations(ordered, F.concat_ws(":", F.col(world).cast("string"), F.col("position").cast("string")), {"order": F.col("_ascending"), "unknown": F.col("class") != "unknown"})


def matched_rights(fixture: DataFrame, lock: DataFrame) -> DataFrame:
    """id and problem of fixture sources that the lock does not have ('unknown') or has under other terms ('rights')."""
    both = fixture.join(lock.select("id", F.col("license").alias("_l"), F.col("attribution").alias("_a"), F.lit(True).alias("_there")), "id", "left")
    wrong = F.when(F.col("_there").isNull(), "unknown").when((F.col("license") != F.col("_l")) | (F.col("attribution") != F.col("_a")), "rights")
    return both.select("id", wrong.alias("problem")).where("problem is not null")


def tile_requests(requests: DataFrame) -> DataFrame:
    """The broken rules of tile requests: side 1 to 2048, guard from what is needed up to 512, origin inside the layout."""
    inside = F.col("x").between(0, F.col("layout_width") - 1) & F.col("y").between(0, F.col("layout_height") - 1)
    return violations(requests, F.col("id"), {"side": F.col("side").between(1, 2048), "guard": F.col("guard").between(F.col("needed"), F.lit(512)), "origin": inside})


def raster_inputs(pixels: DataFrame, ceiling: int) -> DataFrame:
    """The broken rules of depth rasters: coverage 0 or 255, covered depths from 1 to the ceiling, whose 32-fold fits 32 bits."""
    covered = F.col("coverage") == 255
    return violations(pixels, F.concat_ws(":", *[F.col(c).cast("string") for c in ("raster_id", "y", "x")]), {"coverage": F.col("coverage").isin(0, 255), "depth": ~covered | F.col("v").between(1, ceiling), "ceiling": F.lit(0 < ceiling and ceiling * 32 < 2**32)})


def orphans(objects: DataFrame, known: DataFrame) -> DataFrame:
    """(id, source) of objects that name a source that is not known."""
    named = objects.select("id", F.explode("source_ids").alias("source"))
    return named.join(known.select("source"), "source", "left_anti").select("id", "source")
