"""Corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import checkpoint_dir
from tessera.llm.decontaminate import decontaminate
from tessera.llm.mixing import apply_mix, mix
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.queries import TOXIC, table, toxicity_model
from tessera.llm.sharding import shard
from tessera.llm.toxicity import score_toxicity

#: Similarity from which one of two documents goes. (0.85 is the number of op6 alone.)
NEAR_COPY = 0.8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    return score_toxicity(docs, toxicity_model(spark, sf_dir, docs)).where(F.col("score") < TOXIC).drop("score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id. Documents without an id all stay."""
    drop = near_duplicates(docs, threshold=NEAR_COPY).where(~F.col("kept")).select(F.col("doc_id").alias("__id"))
    return docs.join(drop, F.col("doc_id") == F.col("__id"), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.where(F.col("n_hit") == 0).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: repeated whole, and the chosen words where only a part is taken."""
    return apply_mix(docs, mix(docs, ranges=True)).withColumn("n_chars", F.char_length("text").cast("long"))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix."""
    return shard(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: A trained score and signatures can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
