"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>) over the hashed terms that a text holds: its words and the stems of
its longer words. The factors let a pair of terms (an insult with a mention of a group) weigh more or less than its two
terms alone.

The machine is fitted on a bounded sample of labelled texts (`max_rows`, the rows that come first by a hash of their id,
so reruns agree). Spark makes the term lists; one task fits on those of the sample, as its size is bounded, and the driver sees the
machine alone. Every term that is in `least_texts` of them takes part, whatever their labels.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.llm import factorization
from tessera.llm.common import map_texts, words
from tessera.llm.factorization import FactorizationMachine

#: Bytes of a word that make its stem.
STEM = 6


def hashed_terms(text: bytes | None, buckets: int) -> list[int]:
    """Distinct hashed words, and stems of words longer than STEM bytes, of a whole text."""
    own = set(words(text))
    own |= {w[:STEM] + b"*" for w in own if len(w) > STEM}
    return list({zlib.crc32(w) % buckets for w in own})


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, *, id_col: str, text_col: str, max_rows: int) -> DataFrame:
    """(text, label) of at most `max_rows` labelled documents, those first by a hash of the id.

    The chosen label rows are broadcast: their number is bounded by `max_rows`. Null ids and labels are left out; of
    several labels of a document the largest counts, of several texts the first by code point.
    """
    chosen = (
        labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("int").alias("label"))
        .where(F.col("__id").isNotNull() & F.col("label").isNotNull())
        .groupBy("__id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    )
    texts = docs.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "__id").groupBy("__id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = 20_000,
    least_texts: int = 3,
    buckets: int = 1 << 22,
    **fit,
) -> FactorizationMachine:
    """Fit on at most `max_rows` labelled texts; **fit goes to `factorization.fit`.

    A hashed term takes part if `least_texts` of these texts hold it. Without labelled texts the machine is the constant 0.5,
    with fewer than 16 their share of positive ones.
    """
    sample = labelled_sample(docs, labels, label_col, id_col=id_col, text_col=text_col, max_rows=max_rows).withColumn("at", F.xxhash64(F.lit(1), "__id"))
    fields = [T.StructField("terms", T.ArrayType(T.IntegerType()))]

    def terms_of(texts):
        yield pa.array([hashed_terms(t, buckets) for t in texts], pa.list_(pa.int32()))

    found = map_texts(sample, "text", ["at", "label"], fields, terms_of)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)
        m = _fitted(pa.Table.from_batches(own) if own else found_schema.empty_table(), buckets, least_texts, fit)
        yield pa.RecordBatch.from_pydict({"terms": [m.terms.tobytes()], "w0": [m.w0], "w": [m.w.tobytes()], "v": [m.v.tobytes()], "factors": [m.v.shape[1]]})

    found_schema = pa.schema([("at", pa.int64()), ("label", pa.int32()), ("terms", pa.list_(pa.int32()))])
    row = found.repartition(1).mapInArrow(fitted, "terms binary, w0 double, w binary, v binary, factors long").first()
    if row is None:  # no labelled text
        return _fitted(found_schema.empty_table(), buckets, least_texts, fit)
    numbers = lambda name, kind: np.frombuffer(bytes(row[name]), kind)
    return FactorizationMachine(numbers("terms", np.int32), row["w0"], numbers("w", np.float32), numbers("v", np.float32).reshape(-1, row["factors"]), buckets)


def _fitted(found: pa.Table, buckets: int, least_texts: int, fit: dict) -> FactorizationMachine:
    """The machine of a table of (at, label, terms), whose rows are put in the order of `at`."""
    found = found.sort_by("at")
    lists = found.column("terms").combine_chunks()
    flat, counts = lists.flatten().to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False)
    texts = np.bincount(flat, minlength=buckets)
    terms = np.flatnonzero(texts >= least_texts)
    place = np.full(buckets, -1, np.int32)
    place[terms] = np.arange(len(terms))
    rows = [r[r >= 0] for r in np.split(place[flat], np.cumsum(counts)[:-1])] if len(counts) else []
    y = np.array(found.column("label").to_pylist(), dtype=float)
    return factorization.fit(rows, y, terms.astype(np.int32), buckets, **fit)


def score_toxicity(docs: DataFrame, model: FactorizationMachine, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`carry` columns (all by default) of every document and its score, from 0 to 1.

    The score depends on the whole text alone. Null and empty texts get the score of a text without terms. A column named
    score is replaced. The model (a row of factors for each term of the bounded sample) is broadcast.
    """
    bc = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        machine = bc.value
        rows = [np.array(hashed_terms(t, machine.buckets), dtype=np.int32) for t in texts]
        yield pa.array(np.concatenate([machine.scores(rows[at : at + 200]) for at in range(0, len(rows), 200)]) if rows else [], pa.float64())

    return map_texts(docs, text_col, list(docs.columns) if carry is None else carry, [T.StructField("score", T.DoubleType())], run)
