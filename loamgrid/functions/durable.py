"""Intermediate tables that survive lost executors, for jobs that go round until nothing changes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where that is unset: a temporary one in local mode,
    where driver and executors are one process, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="loamgrid-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage."""
    path = f"{shared_dir(df.sparkSession)}/loamgrid/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fanned_out(df: DataFrame, *keys: str) -> DataFrame:
    """df in as many partitions as there are shuffle partitions, by keys: for few small rows that become many further on,
    which would else stay in the few tasks that small tables are read or gathered in."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def removed(df: DataFrame) -> None:
    """Deletes a table of written() that nothing will read again."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(start: DataFrame, step, changed: str = "changed") -> DataFrame:
    """step over and over, from start, until no row has changed; every round is a table of its own.

    step takes the frame without that column and returns it with the boolean column changed.
    """
    now = written(start, "round")
    while True:
        new = written(step(now), "round")
        removed(now)
        now = new.drop(changed)
        if not new.where(changed).limit(1).count():
            return now


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the least node it reaches, for every node of edges (a, b): label propagation with jumps.

    Both sides of its joins are shuffled: a table that is small in its files is sent whole, every round, otherwise.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")

    def step(labels: DataFrame) -> DataFrame:
        heard = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("heard")).hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("heard").alias("heard"))
        told = labels.join(heard.hint("merge"), "node").select("node", F.col("comp").alias("was"), F.least("comp", "heard").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        return told.join(jump.hint("merge"), "comp").select("node", F.least("comp", "next").alias("comp"), (F.least("comp", "next") != F.col("was")).alias("changed"))

    return settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), step)
