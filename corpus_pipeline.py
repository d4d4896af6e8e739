"""The corpus pipeline: documents that are in a learned language, without near copies and benchmark passages, mixed and sharded.

Defined results.  Null texts and texts without a letter go in the first stage.  Rows that
come more than once as they are: one stays after near-dedup.  A null doc_id is the last of
its group; a null source is a source.  Ties are broken by doc_id, then by a hash of the
row.  Very long texts are treated whole.  An empty table gives no rows.  Columns beside
those of documents pass through all stages whatever their names, but shard and slot,
which the last stage sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import decontamination, language_id, mixing, near_dedup, sharding
from glyphmill.llm.layout import new_folder

#: Near-dedup, exact search and hashing run in Python workers and are tested against brute force.
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: those without a letter go, and those whose least loss is above the bound that held-back labelled texts set."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return near_dedup.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark passage."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of the sources take it."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with their shard and their slot in it."""
    return sharding.interleave(docs)


STAGES = [("language ID", identify), ("MinHash near-dedup", deduplicate), ("benchmark decontamination", decontaminate), ("mixing to target weights", mix), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, "stage-" + name.replace(" ", "-").lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
