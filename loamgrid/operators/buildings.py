"""Buildings from records and tagged ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions import tags

#: Confidence in hundredths of a percent with and without evidence of height, of records and of ways.
RECORD, WAY = (9_500, 7_000), (8_500, 6_500)


def last_of_each(ways: DataFrame, order: str = "way_id") -> DataFrame:
    """The last row of every way_id, by order."""
    newest = Window.partitionBy("way_id").orderBy(F.desc(order))
    return ways.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def enriched(records: DataFrame, ways: DataFrame) -> DataFrame:
    """records (building_id, record_id, metres, num_floors) with name, floors and height, from their way where there is one.

    ways: way_id (unique), name and tags. Floors of the record come before those of the way. Records without a way stay.
    Both sides are shuffled: tags are made out of a few bytes a row, whose size would have them sent whole.
    """
    keyed = records.withColumn("osm_id", tags.way_id(F.col("record_id")))
    both = keyed.join(ways.select(F.col("way_id").cast("decimal(20,0)").alias("osm_id"), "name", "tags").hint("merge"), "osm_id", "left")
    both = both.withColumn("floors", F.coalesce("num_floors", tags.small_count(F.col("tags")["building:levels"])))
    sources = F.when(F.col("tags").isNull(), F.array(F.lit("records"))).otherwise(F.array(F.lit("ways"), F.lit("records")))
    return both.withColumn("_h", tags.height(F.col("metres"), F.col("floors"), *RECORD)).select("building_id", "record_id", F.col("osm_id").cast("bigint").alias("osm_id"), "name", "floors", "_h.height_mm", "_h.confidence_bp", "_h.wrong", sources.alias("source_ids"))


def unused(ways: DataFrame, records: DataFrame) -> DataFrame:
    """Floors and height of the ways that no record names."""
    used = records.select(tags.way_id(F.col("record_id")).alias("_used")).where("_used is not null")
    rest = ways.join(used.hint("merge"), F.col("way_id") == F.col("_used"), "left_anti").withColumn("floors", tags.small_count(F.col("tags")["building:levels"]))
    return rest.withColumn("_h", tags.height(tags.number(F.col("tags")["height"]), F.col("floors"), *WAY)).select("way_id", "floors", "_h.height_mm", "_h.confidence_bp", "_h.wrong")
