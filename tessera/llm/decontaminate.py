"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items. For patterns of m words, a table of two-word blocks says how far
the search may move on: a block that ends no window lets it skip up to m - 1 words, a word that no window holds
lets it skip m. Where a block may end a window, the bucket of that suffix block is looked up by the hash of the whole
window and the words are compared directly.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.llm.common import checkpoint, map_texts, words

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class WindowSearch:
    """Wu-Manber tables for windows that all have `m` words."""

    def __init__(self, m: int):
        self.m = m
        self.known: set[bytes] = set()
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[int]]] = {}

    def add(self, window: tuple[bytes, ...], item: int) -> None:
        m, b = self.m, min(2, self.m)
        self.known.update(window)
        for end in range(b, m + 1):
            block = window[end - b : end]
            self.shift[block] = min(self.shift.get(block, m - b + 1), m - end)
        owners = self.buckets.setdefault(window[m - b :], {}).setdefault(window, [])
        if not owners or owners[-1] != item:
            owners.append(item)

    def find(self, text: list[bytes]) -> list[tuple[int, list[int]]]:
        """Start of each occurrence and the items whose window occurs there."""
        m, b = self.m, min(2, self.m)
        known, shift, buckets, far = self.known, self.shift, self.buckets, self.m - b + 1
        found, pos, n = [], m - 1, len(text)
        while pos < n:
            if text[pos] not in known:
                pos += m
                continue
            block = tuple(text[pos - b + 1 : pos + 1])
            move = shift.get(block, far)
            if move:
                pos += move
                continue
            owners = buckets[block].get(tuple(text[pos - m + 1 : pos + 1]))
            if owners:
                found.append((pos - m + 1, owners))
            pos += 1
        return found


def build_search(items: list[bytes | None], window: int) -> list[WindowSearch]:
    """Tables by window length: `window` words, or all words of an item that has fewer; items without words have none."""
    by_length: dict[int, WindowSearch] = {}
    for k, text in enumerate(items):
        w = words(text)
        if w:
            m = min(window, len(w))
            search = by_length.setdefault(m, WindowSearch(m))
            for at in range(len(w) - m + 1):
                search.add(tuple(w[at : at + m]), k)
    return list(by_length.values())


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans [start, end) without overlaps."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _scanner(bc) -> Callable[[list[bytes | None], list | None, list | None], list[pa.Array]]:
    def scan(texts, spans_before=None, items_before=None):
        searches, names = bc.value
        n_words, n_hit, hit_items, hit_spans = [], [], [], []
        for k, text in enumerate(texts):
            w = words(text)
            spans = [(x["start"], x["end"]) for x in spans_before[k]] if spans_before else []
            items = set(items_before[k]) if items_before else set()
            for search in searches:
                for start, owners in search.find(w):
                    spans.append((start, start + search.m))
                    items.update(names[i] for i in owners)
            spans = merge_spans(spans)
            n_words.append(len(w))
            n_hit.append(sum(e - s for s, e in spans))
            hit_items.append(sorted(items, key=str.encode))
            hit_spans.append([{"start": s, "end": e} for s, e in spans])
        return [
            pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
            pa.array(hit_items, pa.list_(pa.string())), pa.array(hit_spans, _SPANS_ARROW),
        ]

    return scan


_FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("hit_items", T.ArrayType(T.StringType())), T.StructField("hit_spans", SPANS),
]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    carry: list[str] | None = None,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """`carry` columns (all by default) of every document, with n_words, n_hit, hit_items and hit_spans.

    hit_spans are word spans [start, end) that occurrences cover, merged; hit_items the distinct ids, as strings, of the
    items with an occurring window. Columns of `docs` with these names are replaced.

    The tables of the items are broadcast in blocks of about `block_bytes` of item text, whose size is counted first; the tables are
    several times that. A benchmark larger than one block is searched for in several passes with a checkpoint between them, so that a
    worker holds one block's tables at a time; no shuffle is needed. A document is never split or cut.

    Null and empty texts have no words. A null item id is named by the empty string; items of equal id count once.
    Repeated documents are each returned. Without items or documents the result has no hits or no rows.
    """
    carry = list(docs.columns) if carry is None else carry
    items = benchmark.select(
        F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.col(f"`{item_text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    total = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    spark, out = docs.sparkSession, None
    for block in range(n_blocks):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == block).toArrow()
        searches = build_search(own.column("text").cast(pa.large_binary()).to_pylist(), window)
        scan = _scanner(spark.sparkContext.broadcast((searches, own.column("id").to_pylist())))
        if out is None:
            keep = [*carry, text_col] if n_blocks > 1 and text_col not in carry else carry
            out = map_texts(docs, text_col, keep, _FIELDS, scan)
        else:
            out = _again(checkpoint(out), text_col, scan)
    return out.select(*[F.col(f"`{c}`") for c in carry if c not in {f.name for f in _FIELDS}], *[f.name for f in _FIELDS])


def _again(df: DataFrame, text_col: str, scan) -> DataFrame:
    """Search the same texts for one more block of items, adding to the hits so far."""
    at, names = df.columns.index(text_col), df.columns
    n = len(names) - len(_FIELDS)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                made = scan(part.column(at).cast(pa.large_binary()).to_pylist(), part.column(n + 3).to_pylist(), part.column(n + 2).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], names=names)

    return df.mapInArrow(run, df.schema)
