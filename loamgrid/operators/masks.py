"""Counts and consistency of semantic mask pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = 24
TRANSIENT = (18, 22)


def class_counts(mask: DataFrame) -> DataFrame:
    """Pixels of every class of the ontology, zeros kept."""
    classes = mask.sparkSession.range(CLASSES).withColumnRenamed("id", "class")
    return classes.join(mask.groupBy("class").agg(F.count("*").alias("n")), "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("pixels"))


def totals(mask: DataFrame) -> DataFrame:
    """Unknown and transient pixels, distinct and greatest instances, all evidence bits."""
    return mask.agg(F.count("*").alias("pixels"), F.count_if(F.col("class") == CLASSES - 1).alias("unknown"), F.count_if(F.col("class").between(*TRANSIENT)).alias("transient"), F.countDistinct(F.when(F.col("instance") > 0, F.col("instance"))).alias("instances"), F.max("instance").alias("max_instance"), F.bit_or("evidence").alias("evidence"))


def mixed_instances(mask: DataFrame) -> DataFrame:
    """Instances with pixels of several classes."""
    return mask.where("instance > 0").groupBy("instance").agg(F.countDistinct("class").alias("classes")).where("classes > 1")
