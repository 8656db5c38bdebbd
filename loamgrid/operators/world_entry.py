"""The world compiled as a whole: objects of records, ways and evidence cells in one table, and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.intmath import floor_div, fnv1a64
from loamgrid.operators import buildings

#: Classes of cells by evidence, what is not known, and the confidence of both in hundredths of a percent.
COVER = {"water": "water", "vegetation": "vegetation", "grass": "terrain", "dry": "terrain"}
UNKNOWN, SEEN = ("unknown", 0), 7_500
VECTORS, EVIDENCE = "vector-only", "vectors-and-evidence"


def compile_world(records: DataFrame, ways: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """id, key, class, name, height_mm, confidence_bp and source_ids of all objects; ids are hashes of keys.

    records: as in buildings.enriched(). ways: way_id (unique), name and tags; those with floors that no record names are
    buildings of their own. cells (col, row, class of evidence.classify()): cover of the ground that no vector gives; a
    cell without a class that is known stays unknown. Without cells the world is of vectors only. Null keys give no object.
    """
    own = buildings.enriched(records, ways).select(F.concat(F.lit("overture:"), "record_id").alias("key"), F.lit("building").alias("class"), "name", "height_mm", "confidence_bp", "source_ids")
    levelled = ways.where(F.col("tags")["building:levels"].isNotNull())
    rest = buildings.unused(levelled, records).join(ways.select("way_id", "name").hint("merge"), "way_id").select(F.concat(F.lit("osm:way:"), F.col("way_id").cast("string"), F.lit(":building")).alias("key"), F.lit("building").alias("class"), "name", "height_mm", "confidence_bp", F.array(F.lit("ways")).alias("source_ids"))
    out = own.unionByName(rest)
    if cells is not None:
        cover = F.element_at(F.create_map(*[F.lit(x) for kv in COVER.items() for x in kv]), F.col("class"))
        ground = cells.select(F.concat_ws(":", F.lit("unknown"), F.col("col").cast("string"), F.col("row").cast("string")).alias("key"), F.coalesce(cover, F.lit(UNKNOWN[0])).alias("class"), F.lit(None).cast("string").alias("name"), F.lit(0).cast("bigint").alias("height_mm"), F.when(cover.isNull(), UNKNOWN[1]).otherwise(SEEN).cast("bigint").alias("confidence_bp"), F.array(F.lit("evidence")).alias("source_ids"))
        out = out.unionByName(ground)
    return out.where("key is not null").withColumn("id", fnv1a64(F.col("key")).cast("string"))


def summary(world: DataFrame) -> DataFrame:
    """One row: objects, named ones, unknown ones in millionths, whether ids are unique, and the status."""
    row = world.agg(F.count("*").alias("objects"), F.count("name").alias("named"), F.count_if(F.col("class") == UNKNOWN[0]).alias("_unknown"), F.collect_set(F.col("source_ids")[0]).alias("_s"), (F.countDistinct("id") == F.count("*")).alias("unique_ids"))
    seen = F.array_contains("_s", "evidence")
    return row.select("objects", "named", F.when(F.col("objects") > 0, floor_div(F.col("_unknown") * 1_000_000, F.col("objects"))).otherwise(0).cast("bigint").alias("unknown_ppm"), "unique_ids", F.when(seen, EVIDENCE).otherwise(VECTORS).alias("status"))
