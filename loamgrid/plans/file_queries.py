"""Queries that write files, read them back and hold manifests against them, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.functions.durable import shared_dir
from loamgrid.operators import publish
from loamgrid.plans.registry import query
from loamgrid.plans.render_queries import IMAGES_SQL, SIDE, pictures
from loamgrid.sources import files

#: Of the tiles of the pictures, some files get a wrong magic, one byte too many, no width or a colour outside the palette;
#: every eighth file is beyond the reader's cap, as are whole tiles of full size with the extra byte.
_KIND = "(id * 31 + col * 7 + row * 3) % 11"
TILES_SQL = f"""{IMAGES_SQL}, t AS (SELECT id, x // {SIDE} AS col, y // {SIDE} AS row, count(DISTINCT x) AS width, count(DISTINCT y) AS height, string_agg(printf('%02x', v), '' ORDER BY y, x) AS body, max(v) AS worst FROM img GROUP BY ALL),
k AS (SELECT *, {_KIND} AS kind, concat(id, '/', col, '_', row, '.idx') AS path FROM t),
f AS (SELECT *, CASE kind WHEN 1 THEN concat('00', substr(full_, 3)) WHEN 2 THEN concat(full_, '00') WHEN 3 THEN concat(substr(full_, 1, 16), '00000000', substr(full_, 25)) ELSE full_ END AS hex FROM (SELECT *, concat('{publish.MAGIC.hex()}', printf('%02x000000', width), printf('%02x000000', height), body) AS full_ FROM k))"""


def tile_files(spark, sf) -> DataFrame:
    """id, col, row, kind, path and content of the pictures' tiles, some of them broken."""
    tiles = publish.encoded(pictures(spark, sf)[0].withColumn("level", F.lit(0))).withColumn("kind", F.expr(_KIND))
    whole = F.col("file")
    n = F.length(whole)
    content = F.when(F.col("kind") == 1, F.concat(F.unhex(F.lit("00")), F.substring(whole, F.lit(2), n))).when(F.col("kind") == 2, F.concat(whole, F.unhex(F.lit("00")))).when(F.col("kind") == 3, F.concat(F.substring(whole, F.lit(1), F.lit(8)), F.unhex(F.lit("00000000")), F.substring(whole, F.lit(13), n))).otherwise(whole)
    return tiles.select("id", "col", "row", "kind", F.concat(F.col("id").cast("string"), F.lit("/"), F.col("col").cast("string"), F.lit("_"), F.col("row").cast("string"), F.lit(".idx")).alias("path"), content.alias("content"))


def folder(spark) -> str:
    return f"{shared_dir(spark)}/loamgrid/files-{uuid.uuid4().hex}"


@query("io20_io26_tile_files", f"""WITH {TILES_SQL} SELECT path, (length(hex) // 2)::BIGINT AS length, CASE WHEN length(hex) // 2 > 272 THEN 'oversized' WHEN kind = 1 THEN 'magic' WHEN kind = 3 THEN 'side' WHEN kind = 2 THEN 'length' WHEN worst >= 15 THEN 'palette' END AS problem,
  CASE WHEN kind NOT IN (1, 2, 3) AND worst < 15 THEN sha256(unhex(hex)) END AS sha256 FROM f""")
def written_tiles(spark, sf) -> DataFrame:
    path = folder(spark)
    files.write_files(tile_files(spark, sf), path)
    read = files.read_files(spark, path, kind="tile", colours=15, most=272)
    return read.select("path", "length", "problem", F.sha2("content", 256).alias("sha256"))


@query("jn8_hp17_io26_layers", f"""WITH {TILES_SQL}, m AS (SELECT path, length(full_) // 2 AS n, CASE WHEN kind = 5 THEN sha256('x') ELSE sha256(unhex(full_)) END AS h FROM f WHERE kind <> 7 UNION ALL SELECT concat(path, '.lost'), 5, sha256('') FROM f WHERE kind = 8 UNION ALL SELECT path, length(full_) // 2, sha256(unhex(full_)) FROM f WHERE kind = 9)
SELECT coalesce(f.path, m.path) AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'extra' WHEN m.c > 1 THEN 'repeated' WHEN length(hex) // 2 > 272 THEN 'oversized' WHEN length(hex) // 2 <> n THEN 'length' ELSE 'altered' END AS problem
FROM f FULL JOIN (SELECT path, count(*) AS c, max(n) AS n, max(h) AS h FROM m GROUP BY path) m ON f.path = m.path WHERE f.path IS NULL OR m.path IS NULL OR c > 1 OR length(hex) // 2 > 272 OR length(hex) // 2 <> n OR sha256(unhex(hex)) <> h""")
def layers(spark, sf) -> DataFrame:
    path = folder(spark)
    made = tile_files(spark, sf)
    files.write_files(made, path)
    good = publish.encoded(pictures(spark, sf)[0].withColumn("level", F.lit(0))).withColumn("kind", F.expr(_KIND))
    name = F.concat(F.col("id").cast("string"), F.lit("/"), F.col("col").cast("string"), F.lit("_"), F.col("row").cast("string"), F.lit(".idx"))
    stated = good.select("kind", name.alias("path"), F.col("bytes").alias("byte_length"), F.when(F.col("kind") == 5, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    lost = stated.where("kind = 8").select(F.concat("path", F.lit(".lost")).alias("path"), F.lit(5).cast("bigint").alias("byte_length"), F.sha2(F.lit(""), 256).alias("sha256"))
    manifest = stated.where("kind <> 7").drop("kind").unionByName(lost).unionByName(stated.where("kind = 9").drop("kind"))
    return files.held_against(manifest, files.scanned(spark, path), 272)
