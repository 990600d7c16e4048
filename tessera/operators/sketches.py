"""Related counts by mergeable sketches: how many different values a group has, kept small and added up over ingest batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: log2 of a sketch's registers: 4,096 registers, a standard error of 1.6 %.
LG_K = 12
#: Relative error that an estimate stays within but for a chance of about 1 in 500 (three standard errors of a merged sketch).
ERROR = 0.05


def sketched(df: DataFrame, keys: list[str], value: str, lg_k: int = LG_K) -> DataFrame:
    """keys, rows and sketch (HyperLogLog) of each group's values; null values count as rows only. Partial sketches are merged before and after one
    exchange, so a group with most rows costs a task no more than its few thousand registers. `value` is an integer, a text or bytes."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.hll_sketch_agg(value, lg_k).alias("sketch"))


def merged(kept: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group of both: rows added, sketches united. The order of batches doesn't matter, nor whether a value came twice;
    `rows` counts what was given, so a batch that is added twice counts twice there and not in the sketch."""
    return kept.unionByName(more).groupBy(*keys).agg(F.sum("rows").alias("rows"), F.hll_union_agg("sketch").alias("sketch"))


def estimated(sketches: DataFrame, keys: list[str], name: str = "different") -> DataFrame:
    """keys, rows and the estimate, which depends on a sketch's registers alone: the same however it was merged. Exact for few values."""
    # a sketch that was never merged would estimate by the history of its rows
    united = sketches.withColumn("sketch", F.hll_union("sketch", "sketch")).groupBy(*keys).agg(F.sum("rows").alias("rows"), F.hll_union_agg("sketch").alias("sketch"))
    return united.select(*keys, "rows", F.hll_sketch_estimate("sketch").alias(name))
