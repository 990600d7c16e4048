"""Presentation contexts: which are accepted, and with which transfer syntax. Joins and array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ACCEPTED, ABSTRACT_REJECTED, TRANSFER_REJECTED = 0, 3, 4
EXPLICIT_LE, IMPLICIT_LE = "1.2.840.10008.1.2.1", "1.2.840.10008.1.2"


def preferred(offered: Column, preference: Column) -> Column:
    """The first preferred element that is offered; null if none is."""
    return F.try_element_at(F.array_intersect(preference, offered), F.lit(1))


def default_uncompressed(offered: Column) -> Column:
    return preferred(offered, F.array(F.lit(EXPLICIT_LE), F.lit(IMPLICIT_LE)))


def negotiate(contexts: DataFrame, known: DataFrame, abstract: str, offered: str, preference: Column) -> DataFrame:
    """Adds result and transfer_syntax to each proposed context. known: one column named as `abstract`, the supported ones."""
    mark = known.select(F.col(abstract)).distinct().withColumn("__known", F.lit(True))
    out = contexts.join(mark, abstract, "left")
    chosen = preferred(F.col(offered), preference)
    result = F.when(F.col("__known").isNull(), ABSTRACT_REJECTED).when(chosen.isNull(), TRANSFER_REJECTED).otherwise(ACCEPTED)
    return out.withColumn("result", result).withColumn("transfer_syntax", F.when(F.col("result") == ACCEPTED, chosen)).drop("__known")


def accepted(contexts: DataFrame) -> DataFrame:
    return contexts.where(F.col("result") == ACCEPTED)


def first_accepted(contexts: DataFrame, association: str, context: str) -> DataFrame:
    """The accepted context with the smallest id of each association."""
    return accepted(contexts).groupBy(association).agg(F.min(context).alias(context))
