"""Streams with state beyond one message: responses joined with their requests, and messages assembled with timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.plans.dims import STATUS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def answered_in_time(requests: DataFrame, responses: DataFrame, key: str, request_ts: str, response_ts: str, status: str, within: str, late: str = "1 day") -> DataFrame:
    """Each request with every response of its key that came at most `within` after it; one that had none gets status 0211.

    Both sides may be streams: rows that come more than `late` after the newest of their side are dropped, and a request's state ends, with 0211
    where nothing answered it, once the watermark has passed its time and `within`; a response's once no request can fit it any more. As
    batches the same rows come out at once. A request without key or time is never answered (and has no end in a stream); a response
    without a status counts as an answer, with status null. Columns of the two sides must differ but for the key.
    """
    own = requests.withWatermark(request_ts, late)
    other = responses.withWatermark(response_ts, late).withColumnRenamed(key, "__key").withColumn("__answer", F.lit(True))
    fits = (F.col(key) == F.col("__key")) & (F.col(response_ts) >= F.col(request_ts)) & (F.col(response_ts) <= F.col(request_ts) + F.expr(f"INTERVAL {within}"))
    out = own.join(other, fits, "leftOuter")
    return out.withColumn(status, F.when(F.col("__answer"), F.col(status)).otherwise(F.lit(STATUS["no_provider"]))).drop("__key", "__answer")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started within keep their state in RocksDB, which list state and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Assembler(StatefulProcessor):
    """One association: its parts as list state, to which only new parts are added; the message's number and the timer as value state."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "data string")
        self.told = handle.getValueState("told", "number long, parts long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        number, held, due = self.told.get() if self.told.exists() else (0, 0, -1)
        fresh, out, newest = [], [], due - self.idle_ms
        for seq, data, last, ms in sorted((t for f in rows for t in zip(f["seq"], f["data"], f["is_last"], f["ms"], strict=True)), key=lambda t: t[0]):
            fresh.append(data or "")
            newest = max(newest, int(ms))
            if last:
                before = [x[0] for x in self.parts.get()] if held else []
                out.append((key[0], number, held + len(fresh), "".join([*before, *fresh]), True))
                if held:
                    self.parts.clear()
                number, held, fresh = number + 1, 0, []
        if fresh:
            self.parts.appendList([(x,) for x in fresh])
        if newest + self.idle_ms != due:
            if due >= 0:
                self.handle.deleteTimer(due)
            due = newest + self.idle_ms
            self.handle.registerTimer(due)
        self.told.update((number, held + len(fresh), due))
        yield pd.DataFrame(out, columns=["association", "message", "parts", "data", "complete"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, held, _ = self.told.get()
        out = [(key[0], number, held, "".join(x[0] for x in self.parts.get()), False)] if held else []
        self.parts.clear()
        self.told.clear()
        yield pd.DataFrame(out, columns=["association", "message", "parts", "data", "complete"])

    def close(self) -> None:
        pass


def assembled_until_idle(pdvs: DataFrame, association: str, order: str, data: str, is_last: str, ts: str, idle_seconds: int, late: str = "0 seconds") -> DataFrame:
    """(association, message, parts, data, complete): whole messages of a stream of PDVs, numbered from 0 in each association.

    A message may span micro-batches; a part is stored once and read once, when its message ends, so a long message costs as much as its
    parts. Within a batch parts are ordered by `order`. An association ends when the watermark (`late` behind the newest `ts` of the stream) passes its own
    newest `ts` by `idle_seconds`: what it holds of a message comes out with complete = false, its state goes, and a part that comes later
    begins at number 0 again. Any part before that moves the end. Null data count as empty; `ts` must not be null. Start the query
    within `rocksdb_state`.
    """
    kind = pdvs.schema[association].dataType
    own = pdvs.select(F.col(association).alias("association"), F.col(order).alias("seq"), F.col(data).cast("string").alias("data"), F.coalesce(F.col(is_last), F.lit(False)).alias("is_last"), F.col(ts).alias("ts"))
    own = own.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    schema = T.StructType([T.StructField("association", kind), T.StructField("message", T.LongType()), T.StructField("parts", T.LongType()), T.StructField("data", T.StringType()), T.StructField("complete", T.BooleanType())])
    return own.groupBy("association").transformWithStateInPandas(Assembler(idle_seconds * 1000), schema, "Append", "EventTime")
