"""Hard negatives by threshold joins of anchors with all rows, after L2AP: an inverted index that leaves out what norms rule out.

Anchors are taken in blocks of a bounded size. The dimensions of a block are put in order of their weight and cut into slots; an anchor is
entered in the lists of its first slots only, until what its remaining part could add to a score with the longest row, by Cauchy and Schwarz, stays
below the anchor's threshold. A row meets the lists slot by slot: partial scores accumulate, and a pair is given up as soon as its partial score
and the norms of what remains of both can't reach the threshold. What is left is scored exactly, in whole numbers.

Thresholds begin high and are lowered until each window is filled: first until an anchor has its positives, then, from each positive's score down,
until it has its negatives or the window's lower end is reached. Every round is one pass of Spark over all rows for the windows still open. A task
keeps the first `k` rows of each window, whatever it reads, and these meet again by window, so no label, vector or window is one task's.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessera.llm.common import checkpoint_dir

#: Dimensions of a slot, cells of a block of partial scores, and pairs that are scored at a time.
SLOT, CELLS, PAIRS = 8, 2_000_000, 50_000
#: Thresholds of the rounds: parts of the anchor's own squared norm, at last none; parts of the positive's score, at last the window's end.
POSITIVE_STEPS, NEGATIVE_STEPS = (0.8, 0.5, 0.35, 0.2), (0.95, 0.88)
#: Norms are taken this much larger, for what floating point may lose.
SLACK = 1e-6


def whole_numbers(vectors: DataFrame, vector: str, scale: float) -> DataFrame:
    """Rows with q, the components times `scale` rounded down, of those whose vector is there, has neither nulls nor other than finite
    components, and is short enough for scores in a long: its squared norm is below 2^62."""
    double = F.transform(F.col(f"`{vector}`"), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    told = F.coalesce(F.forall(F.col(f"`{vector}`"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    norm2 = F.aggregate(double, F.lit(0.0), lambda a, x: a + x * x)
    # floor of a double saturates as a long, far beyond the norms that stay
    return vectors.where(told).where(norm2 < 2.0**62).withColumn("q", F.transform(double, lambda x: x.cast("long")))


@dataclass
class Anchors:
    """A block of anchors: labels, vectors (anchors x dimensions, whole numbers)."""

    labels: np.ndarray
    q: np.ndarray

    def __post_init__(self) -> None:
        self.order = np.argsort(-(self.q.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        self.weights = self.q[:, self.order].astype(np.float64)
        self.rest = remaining(self.weights)


def remaining(x: np.ndarray) -> np.ndarray:
    """Norms of what is left of each vector from each slot on, the last column being nothing."""
    slots = -(-x.shape[1] // SLOT)
    squares = np.add.reduceat(x**2, np.arange(0, x.shape[1], SLOT), axis=1) if slots else np.zeros((len(x), 0))
    tail = np.sqrt(np.concatenate([np.cumsum(squares[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1))], axis=1))
    return tail + SLACK * tail[:, :1]


def indexed_slots(rest: np.ndarray, low: np.ndarray, longest: float) -> np.ndarray:
    """How many slots of each anchor the index must hold so that no row of norm `longest` that meets none of them reaches `low`."""
    return (rest[:, :-1] * longest >= low[:, None]).sum(axis=1)


def candidates(block: Anchors, who: np.ndarray, low: np.ndarray, slots: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in `who`) of the pairs that may reach the anchor's threshold. `who` are anchors with most indexed slots first."""
    x = rows[:, block.order].astype(np.float64)
    weights, rest, x_rest = block.weights[who], block.rest[who], remaining(x)
    acc, bound = np.zeros((len(x), len(who))), np.full((len(x), len(who)), -np.inf)
    for s in range(slots.max(initial=0)):
        n, at = int((slots > s).sum()), slice(s * SLOT, (s + 1) * SLOT)
        acc[:, :n] += x[:, at] @ weights[:n, at].T
        bound[:, :n] = acc[:, :n] + x_rest[:, s + 1, None] * rest[None, :n, s + 1]
        if np.count_nonzero(bound >= low) * 16 < bound.size:
            break  # few pairs are left: scoring them costs less than the next lists
    return np.nonzero(bound >= low)


def first_of(window: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first `k` of each window: higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -score, window))
    starts = np.flatnonzero(np.diff(window[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
    return order[rank < k]


@dataclass
class Windows:
    """Open windows, those of an anchor side by side: the anchor's place in its block, the scores it spans, whether labels must be equal."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same_label: bool


def search(block: Anchors, block_ids: np.ndarray, windows: Windows, k: int, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, score, id) of the first k of these rows in each window. A row never is in a window of an anchor of its own id."""
    who, first, count = np.unique(windows.anchor, return_index=True, return_counts=True)
    # int64 thresholds may not be exact as doubles: the margin covers it, and scores are compared as whole numbers below
    low = np.minimum.reduceat(windows.low, first).astype(np.float64)
    low = low - np.abs(low) * 1e-12
    norms = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(norms, kind="stable")
    kept = (np.zeros(0, np.int64),) * 3
    step = max(1, CELLS // max(1, len(who)))
    for at in range(0, len(order), step):
        part = order[at : at + step]
        slots = indexed_slots(block.rest[who], low, norms[part[-1]] * (1 + SLACK))
        most = np.argsort(-slots, kind="stable")
        found_row, found_who = candidates(block, who[most], low[most], slots[most], rows[part])
        found_row, found_who = part[found_row], most[found_who]
        fits = (labels[found_row] == block.labels[who[found_who]]) == windows.same_label
        fits &= ids[found_row] != block_ids[who[found_who]]
        found_row, found_who = found_row[fits], found_who[fits]
        for cut in range(0, len(found_row), PAIRS):
            r, w = found_row[cut : cut + PAIRS], found_who[cut : cut + PAIRS]
            score = np.einsum("ij,ij->i", rows[r], block.q[who[w]])
            own = count[w]
            window = np.repeat(first[w] - np.cumsum(own) + own, own) + np.arange(own.sum())
            score, r = np.repeat(score, own), np.repeat(r, own)
            inside = (score >= windows.low[window]) & (score <= windows.high[window])
            merged = tuple(np.concatenate([a, b[inside]]) for a, b in zip(kept, (window, score, ids[r]), strict=True))
            best = first_of(*merged, k)
            kept = tuple(m[best] for m in merged)
    return kept


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows x dims of a column of lists; shorter vectors end in zeros."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), dims), np.int64)
    values = values[offsets[0] : offsets[-1]]
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = values
    return out


INF = np.iinfo(np.int64).max


class _Search:
    """Rounds over one block of anchors; what they find is written as tables of (anchor, anchor_id, high, round, score, id)."""

    def __init__(self, spark: SparkSession, rows: DataFrame, block: pa.Table, number: int, dims: int, k: int, folder: str):
        self.spark, self.rows, self.dims, self.k, self.folder, self.number = spark, rows, dims, k, folder, number
        self.ids = block.column("vec_id").to_numpy()
        self.block = Anchors(block.column("label").to_numpy(), matrix(block.column("q").combine_chunks(), dims))

    def round(self, windows: Windows, name: str, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Pass over all rows; gives (window, score) of what was found."""
        block, ids, dims, k, first = self.block, self.ids, self.dims, self.k, self.number << 32

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = (np.zeros(0, np.int64),) * 3
            for batch in batches:
                own = search(block, ids, windows, k, batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), dims))
                merged = tuple(np.concatenate(x) for x in zip(kept, own, strict=True))
                best = first_of(*merged, k)
                kept = tuple(m[best] for m in merged)
            w, score, found = kept
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w, first + windows.anchor[w], ids[windows.anchor[w]], windows.high[w], score, found)], names=["w", "anchor", "anchor_id", "high", "score", "id"])

        made = self.rows.mapInArrow(run, "w long, anchor long, anchor_id long, high long, score long, id long")
        rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "id"))
        path = f"{self.folder}/{name}/block={self.number}/round={number}"
        made.withColumn("rank", rank).where(F.col("rank") <= k).write.parquet(path)
        got = self.spark.read.parquet(path).select("w", "score").toArrow()
        return got.column("w").to_numpy(), got.column("score").to_numpy()

    def positives(self) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, score) of the first k rows of each anchor's label."""
        norm2 = (self.block.weights**2).sum(axis=1)
        todo, found = np.arange(len(self.ids)), []
        for number, part in enumerate((*POSITIVE_STEPS, -math.inf)):
            low = np.full(len(todo), -INF) if part < 0 else np.ceil(part * norm2[todo]).astype(np.int64)
            w, score = self.round(Windows(todo, low, np.full(len(todo), INF), True), "positives", number)
            full = (np.bincount(w, minlength=len(todo)) >= self.k) | (part < 0)
            found.append((todo[w[full[w]]], score[full[w]]))
            todo = todo[~full]
            if not len(todo):
                break
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def negatives(self, anchor: np.ndarray, score: np.ndarray, least: tuple[int, int]) -> bool:
        """The first k rows of other labels in the window below each positive's score; gives whether there was any window."""
        pairs = np.unique(np.stack([anchor, score], axis=1)[score >= 0], axis=0)
        ends = np.array([-(-least[0] * int(s) // least[1]) for s in pairs[:, 1]], np.int64)
        any_windows = len(pairs) > 0
        for number, part in enumerate((*NEGATIVE_STEPS, 0.0)):
            if not len(pairs):
                break
            low = np.maximum(ends, np.ceil(part * pairs[:, 1]).astype(np.int64))
            w, _ = self.round(Windows(pairs[:, 0], np.minimum(low, pairs[:, 1]), pairs[:, 1], False), "negatives", number)
            open_ = (np.bincount(w, minlength=len(pairs)) < self.k) & (low > ends)
            pairs, ends = pairs[open_], ends[open_]
        return any_windows


def _last_round(spark: SparkSession, folder: str) -> DataFrame:
    """What each window held in the last round it was open: a lower threshold finds what a higher one does, and more."""
    found = spark.read.schema("w long, anchor long, anchor_id long, high long, score long, id long, rank int, block int, round int").parquet(folder)
    last = F.max("round").over(Window.partitionBy("anchor", "high"))
    return found.withColumn("__last", last).where(F.col("round") == F.col("__last"))


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0, k: int = 5, least: tuple[int, int] = (80, 100), block_rows: int = 16_384) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), rank from 1.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part, nor do vectors too long for scores in a
    long. `anchor` tells the rows that are anchors, `label` replaces the label. Components are scaled and rounded down; a score is the inner
    product, shorter vectors ending in zeros. An anchor's positives are its first k rows of equal label and other id; for each the first k rows of
    another label, whose score is at most the positive's and at least `least` of it (a positive below zero has none). Higher scores come
    first, then smaller ids; repeated rows each count, repeated anchors are one. A table without rows or anchors gives no rows.

    The driver holds `block_rows` anchors and the scores in their windows at a time, at most; all results stay in Spark.
    """
    spark = vectors.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/negatives-{uuid.uuid4().hex}"
    own = whole_numbers(vectors, vector_col, scale).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), (F.col(f"`{label_col}`") if label is None else label).cast("long").alias("label"), "q", F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    own.where("vec_id IS NOT NULL AND label IS NOT NULL").write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    rows.where("is_anchor").select("vec_id", "label", "q").distinct().write.parquet(f"{folder}/anchors")
    anchors = spark.read.parquet(f"{folder}/anchors")
    n, dims = anchors.count(), rows.agg(F.coalesce(F.max(F.size("q")), F.lit(0))).first()[0]
    blocks = -(-2 * n // block_rows)  # half full on average: by hash, none comes near twice that
    any_windows = False
    for number in range(blocks):
        block = anchors.where(F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(blocks)) == number).toArrow()
        if block.num_rows:
            job = _Search(spark, rows.select("vec_id", "label", "q"), block, number, dims, k, folder)
            any_windows |= job.negatives(*job.positives(), least)
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not any_windows:
        return spark.createDataFrame([], names)
    positives = _last_round(spark, f"{folder}/positives").select("anchor", F.col("score").alias("high"), F.col("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    negatives = _last_round(spark, f"{folder}/negatives").select("anchor", "high", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(negatives, ["anchor", "high"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
