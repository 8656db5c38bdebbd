"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgrid.functions.durable import written  # noqa: F401

#: Characters that separate words, as the body of a regular-expression class.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


def removed(df: DataFrame) -> None:
    """Deletes a table of written() that nothing will read again."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int):
    """While it lasts, jobs hand Python so many rows at a time: bounds the memory of rows that carry arrays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash60(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts joined by '/': the same number in any SQL engine. A null part counts as ''."""
    text = F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def crc_mod3(doc_id: Column) -> Column:
    """crc32 of doc_id written as text, modulo 3 (null: as '')."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(3))


def running_offset(df: DataFrame, groups: list[str], key: str, order: list[str], weight: Column, n_rows: int, out: str, counted: DataFrame | None = None) -> DataFrame:
    """Adds out: the sum of weight over the rows of the same group that come earlier by (key, *order).

    key is a 60-bit hash column. Its leading bits cut every group into about sqrt(n_rows) ranges. Sums of the ranges
    are added up on their own, so neither step holds more than about sqrt(n_rows) rows of one group in a task, however
    large the group is. groups must not be null. counted: a cheaper frame with the same groups, key and weights.
    """
    bits = min(40, max(0, math.ceil(math.log2(max(n_rows, 1)) / 2)))
    part = F.shiftright(F.col(key), 60 - bits) if bits else F.lit(0).cast("bigint")
    keys = [*groups, "_part"]
    sums = (df if counted is None else counted).groupBy(*groups, part.alias("_part")).agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys).orderBy(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("_part", part).withColumn("_in", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return placed.join(starts, keys).withColumn(out, (F.col("_start") + F.col("_in")).cast("bigint")).drop("_part", "_in", "_start")
