"""Fragments, frames and protocol chunks: running offsets, ordered concatenation, splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ITEM_HEADER = 8


def fragment_offsets(fragments: DataFrame, group: list[str], order: list[str], length: Column) -> DataFrame:
    """Adds `offset`: where each fragment starts, the sum of 8 + length of those before it in its group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return fragments.withColumn("offset", F.coalesce(F.sum(length + ITEM_HEADER).over(w), F.lit(0)))


def stream_length(fragments: DataFrame, group: list[str], length: Column) -> DataFrame:
    return fragments.groupBy(*group).agg(F.sum(length + ITEM_HEADER).alias("stream_length"), F.count("*").alias("n_fragments"))


def assemble(fragments: DataFrame, group: list[str], order: str, data: str, out: str = "data") -> DataFrame:
    """The fragments of each group, one after the other."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(data).alias("d"))))
    return fragments.groupBy(*group).agg(F.array_join(F.transform(parts, lambda p: p["d"]), "").alias(out))


def frames_by_offsets(fragments: DataFrame, table: DataFrame, group: list[str], order: list[str], length: Column) -> DataFrame:
    """Adds `frame`: the number of the frame whose offset was met last. table: group columns, frame, offset.

    A table offset must be the start of a fragment: the join is an equality, and rows before the first offset have no frame.
    """
    at = fragment_offsets(fragments, group, order, length).join(table, [*group, "offset"], "left")
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return at.withColumn("frame", F.last("frame", ignorenulls=True).over(w))


def chunk_length(max_pdu: int) -> int | None:
    """Bytes of payload a chunk takes; None: all of them."""
    return None if max_pdu == 0 else max(1, max_pdu - 12)


def chunks(messages: DataFrame, keep: list[str], data: Column, max_pdu: int) -> DataFrame:
    """keep, chunk, is_last, data: the payload in pieces that fit a PDU. An empty payload is one empty chunk."""
    most = chunk_length(max_pdu)
    n = F.lit(1) if most is None else F.greatest(F.lit(1), F.ceil(F.length(data) / most)).cast("int")
    own = messages.select(*keep, data.alias("__data"), n.alias("__n")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    piece = F.col("__data") if most is None else F.substring("__data", F.col("chunk") * most + 1, F.lit(most))
    return own.select(*keep, "chunk", (F.col("chunk") == F.col("__n") - 1).alias("is_last"), piece.alias("data"))


def messages(pdvs: DataFrame, association: str, order: str, is_last: Column) -> DataFrame:
    """Adds `message`: the number of the message that a PDV belongs to; a message ends with its last PDV."""
    w = Window.partitionBy(association).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return pdvs.withColumn("message", F.coalesce(F.sum(is_last.cast("int")).over(w), F.lit(0)))


def sessions(events: DataFrame, association: str, ts: str, order: str, gap: str) -> DataFrame:
    """Adds `session`: a new one starts after a pause of at least `gap` in an association."""
    w = Window.partitionBy(association).orderBy(ts, order)
    starts = F.coalesce(F.col(ts) >= F.lag(ts).over(w) + F.expr(f"INTERVAL {gap}"), F.lit(True))
    return events.withColumn("__new", starts.cast("int")).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
