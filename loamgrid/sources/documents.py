"""JSON sources: source locks, tagged ways, features and manifests, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TEXTS = "release source_date acquired_at license attribution metadata_url"
RECORD = ", ".join(["id: string, kind: string, role: string, approved: boolean, raw_content_in_final_output: boolean, size_bytes: bigint, sha256: string", *[f"{n}: string" for n in _TEXTS.split()], "acquisition: struct<kind: string, url: string, etag: string, path: string, filename: string>"])
LOCK = f"schema string, region_id string, sources array<struct<{RECORD}>>"
WAYS = "elements array<struct<type: string, id: bigint, tags: map<string, string>, geometry: array<struct<lon: double, lat: double>>>>"
FEATURES = "features array<struct<id: string, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each file; a file that does not parse as the schema fails the job."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def parsed(texts: DataFrame, schema: str, column: str = "content") -> DataFrame:
    """texts with column, a JSON text, parsed into doc."""
    return texts.withColumn("doc", F.from_json(column, schema))


def lock_records(docs: DataFrame, *keep: str) -> DataFrame:
    """The records of source locks (doc), with their position, schema and region."""
    each = docs.select(*keep, F.col("doc.schema").alias("schema"), F.col("doc.region_id").alias("region_id"), F.posexplode("doc.sources").alias("position", "_s"))
    return each.select(*keep, "schema", "region_id", "position", "_s.*")


def selected(records: DataFrame, wanted: list[str]) -> DataFrame:
    """The records of the wanted ids, all if none are named. An id that is unknown or named twice raises a ValueError."""
    if not wanted:
        return records
    found = {r["id"] for r in records.where(F.col("id").isin(wanted)).select("id").distinct().collect()}  # len(wanted) at most
    if len(set(wanted)) < len(wanted) or found != set(wanted):
        raise ValueError("ids are unknown or named twice")
    return records.where(F.col("id").isin(wanted))


def ways(docs: DataFrame, *keep: str) -> DataFrame:
    """way_id, tags and path (lon, lat) of the ways of OSM documents (doc); other elements give no rows."""
    each = docs.select(*keep, F.explode("doc.elements").alias("_e")).where("_e.type = 'way'")
    return each.select(*keep, F.col("_e.id").alias("way_id"), F.coalesce("_e.tags", F.create_map().cast("map<string,string>")).alias("tags"), F.col("_e.geometry").alias("path"))


def polygons(docs: DataFrame, *keep: str) -> DataFrame:
    """feature_id, parts (of rings of [lon, lat]) and kind of GeoJSON features (doc); parts is null for other kinds."""
    each = docs.select(*keep, F.explode("doc.features").alias("_f")).select(*keep, F.col("_f.id").alias("feature_id"), F.col("_f.geometry.type").alias("kind"), F.col("_f.geometry.coordinates").alias("_c"), F.col("_f.properties").alias("properties"))
    one = F.from_json("_c", "array<array<array<double>>>")
    many = F.from_json("_c", "array<array<array<array<double>>>>")
    parts = F.when(F.col("kind") == "Polygon", F.array(one)).when(F.col("kind") == "MultiPolygon", many)
    return each.withColumn("parts", parts).drop("_c")


def artifact_path(digest, filename):
    """sha256/<two digits>/<digest>/<file name>."""
    return F.concat_ws("/", F.lit("sha256"), F.substring(digest, 1, 2), digest, filename)


def verified(records: DataFrame, files: DataFrame) -> DataFrame:
    """id and problem of each record (id, sha256, size_bytes, filename) against files (path, content, length).

    problem: 'missing', 'length', 'digest' or null. Only the content of files of the right length is read.
    """
    named = records.withColumn("path", artifact_path(F.col("sha256"), F.col("filename")))
    both = named.join(files.select("path", "length", "content"), "path", "left")
    wrong = F.when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("size_bytes"), "length").when(F.sha2("content", 256) != F.col("sha256"), "digest")
    return both.select("id", wrong.alias("problem"))


def descriptor(width, height, side: int, overlap: int, suffix: str):
    """The XML descriptor of a deep-zoom image."""
    # Fixed value: the descriptor's text.
    text = f'<?xml version="1.0" encoding="UTF-8"?>\n<Image TileSize="{side}" Overlap="{overlap}" Format="{suffix}" xmlns="http://schemas.microsoft.com/deepzoom/2008">\n  <Size Width="%d" Height="%d"/>\n</Image>\n'
    return F.format_string(text, width, height)
