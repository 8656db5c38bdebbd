"""The corpus pipeline: language, near duplicates, benchmark leaks, mixing, shards.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm import decontaminate, language, minhash, mixing, sharding
from loamgrid.llm.common import table, written

#: Documents that no language codes in fewer bits a byte than plain bytes take are rejected.
MOST_BITS = 8.0
SHARDS = 24


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null, no letters, or coded no better than plain bytes by every language.

    Repeated rows stay; no rows give no rows; other columns come out as they are, whatever their names.
    """
    judged = language.identify(docs, keep=True).where((F.col("lang_pred") != "und") & (F.col("bits") < MOST_BITS))
    return judged.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of near duplicates: five-word shingles, similarity of 0.8 or more.

    Of repeated rows one stays; null and empty texts have no copies but rows of the same id.
    """
    return minhash.distinct_documents(docs, size=5, hundredths=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, edits allowed. Null and empty texts hold none; an empty benchmark drops nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that the mix of sources takes, repeats as rows of their own. Texts without words have none."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its size, checksum, shard and slot; a column of docs with one of these names gives way."""
    return sharding.shard(docs, sharding.tree(SHARDS), sharding.tree(SHARDS + 1), keep=True)


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Language codes and edit matches have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
