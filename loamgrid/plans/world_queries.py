"""Queries of the compiled world, with vectors only and with evidence, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loamgrid.operators import evidence, world_entry
from loamgrid.plans.feature_queries import _RECORDS, records, ways
from loamgrid.plans.inputs import points
from loamgrid.plans.queries import EVIDENCE_SQL, FNV_SQL
from loamgrid.plans.registry import SQL, query

VECTORS_SQL = f"""SELECT concat('overture:', record_id) AS k, 'building' AS class, j.name, height_mm, confidence_bp, CASE n_sources WHEN 1 THEN 'records' ELSE 'ways' END AS source FROM ({SQL['jn1_sf23_buildings']}) j JOIN ({_RECORDS}) r USING (building_id)
  UNION ALL SELECT concat('osm:way:', way_id, ':building'), 'building', p_name, height_mm, confidence_bp, 'ways' FROM ({SQL['jn2_unused_ways']}) JOIN part ON p_partkey = way_id"""
CELLS_SQL = f"SELECT concat('unknown:', col, ':', row), CASE class WHEN 'water' THEN 'water' WHEN 'vegetation' THEN 'vegetation' WHEN 'unknown' THEN 'unknown' ELSE 'terrain' END, NULL, 0, CASE class WHEN 'unknown' THEN 0 ELSE 7500 END, 'evidence' FROM (WITH {EVIDENCE_SQL} SELECT * FROM cells)"


def compiled(spark, sf, seen: bool) -> DataFrame:
    return world_entry.compile_world(records(spark, sf), ways(spark, sf), evidence.classify(points(spark, sf)) if seen else None)


@query("hp2_vector_world", f"WITH w AS ({VECTORS_SQL}) SELECT k AS key, class, name, height_mm::BIGINT AS height_mm, confidence_bp::BIGINT AS confidence_bp, ({FNV_SQL})::VARCHAR AS id FROM w WHERE k IS NOT NULL")
def vector_world(spark, sf) -> DataFrame:
    return compiled(spark, sf, False).drop("source_ids")


@query("hp2_world_summary", f"WITH w AS ({VECTORS_SQL} UNION ALL {CELLS_SQL}) SELECT count(*) AS objects, count(name) AS named, count_if(class = 'unknown') * 1000000 // count(*) AS unknown_ppm, count(DISTINCT k) = count(*) AS unique_ids, 'vectors-and-evidence' AS status FROM w WHERE k IS NOT NULL")
def world_summary(spark, sf) -> DataFrame:
    return world_entry.summary(compiled(spark, sf, True))
