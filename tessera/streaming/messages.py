"""Message services on Structured Streaming: a stream of instances or messages to a table, statuses by provider."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.plans.dims import STATUS


def message_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; `glob` picks files by name, or folders with all files in them, as Spark's writers make of a table."""
    if not glob:
        return spark.readStream.schema(schema).parquet(folder)
    # in braces a plain name is a pattern too: Spark takes a path without one for a folder
    return spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/{{{glob}}}")


def answered(messages: DataFrame, providers: DataFrame, service: str) -> DataFrame:
    """Adds status: that of the provider of a message's service, 0211 where none is registered. providers: service column, status."""
    return messages.join(F.broadcast(providers), service, "left").withColumn("status", F.coalesce("status", F.lit(STATUS["no_provider"])))


def stored_once(stream: DataFrame, out: str, state: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Process all that is there now, each micro-batch written once under its number.

    A batch that is repeated after a failure overwrites its own folder, so no row is stored twice. Called again with the same `out` and
    `state`, it goes on where it was, with what has come since.
    """

    def store(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(store).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def run_available(stream: DataFrame, folder: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """`stored_once` to a folder of its own, read back; a stream without files gives no rows."""
    out = f"{folder.rstrip('/')}/stored-{uuid.uuid4().hex}"
    stored_once(stream, out, f"{out}-state", transform)
    try:
        return stream.sparkSession.read.parquet(out).drop("batch")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return stream.sparkSession.createDataFrame([], transform(stream).schema)


def windowed_counts(messages: DataFrame, ts: str, service: str, late: str = "1 day", width: str = "6 hours") -> DataFrame:
    """Messages by window and service, with a watermark for late ones."""
    return messages.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), service).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), service, "n")


def assembled(pdvs: DataFrame, association: str, order: str, data: str, is_last: str, idle_ms: int | None = None) -> DataFrame:
    """(association, message, parts, data): whole messages of a stream of PDVs, numbered from 0 in each association.

    What an association has sent of a message that hasn't ended is its state, so a message may span micro-batches. PDVs of an
    association arrive in order from batch to batch; within one they are ordered by `order`. The state of an association that sends
    nothing for `idle_ms` is removed, and what it held of a message with it; one that sends again then is numbered from 0. Without
    `idle_ms` a number and an unfinished message for each association stay: right for a stream that ends when all is read, which with a
    timeout would wait for it.
    """
    own = pdvs.select(F.col(association).alias("association"), F.col(order).alias("seq"), F.col(data).cast("string").alias("data"), F.col(is_last).alias("is_last"))
    kind = own.schema["association"].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        number, parts, held = state.get if state.exists else (0, 0, "")
        rows = sorted((t for f in frames for t in zip(f["seq"], f["data"], f["is_last"], strict=True)), key=lambda r: r[0])
        out = []
        for _, piece, last in rows:
            held, parts = held + (piece or ""), parts + 1
            if last:
                out.append((key[0], number, parts, held))
                number, parts, held = number + 1, 0, ""
        state.update((number, parts, held))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["association", "message", "parts", "data"])

    return own.groupBy("association").applyInPandasWithState(step, f"association {kind}, message long, parts long, data string", "message long, parts long, data string", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
