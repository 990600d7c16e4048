"""Sharding by histogram sort. DataFrame functions only.

Rows are ordered by a key of three numbers: a hash of the text, a hash of the id, and a hash of where the row was read, so
that rows with equal texts are neighbours and a group too large for one shard can still be cut. Boundaries between
equal numbers of bytes are searched for by histograms: the exact bytes below evenly spaced probes are counted
over all partitions, the probe interval that holds a wanted boundary is probed again more finely, and so on until every
boundary meets the tolerance. Only then are the rows exchanged, once, by the piece of the order that they lie in.

Each shard is made of `pieces` such pieces, so that the rows of a shard are numbered by many tasks.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.common import checkpoint

BITS = 60  #: of each key
FIRST, NEXT = 12, 8  #: bits that the first and every later round of probes tell apart


def _key(*c: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*c), 64 - BITS)


def _refine(rows: DataFrame, total: int, cuts: int, tolerance: int) -> list[tuple[int, int, int]]:
    """`cuts` - 1 boundaries (k1, k2, k3): a row is below a boundary if its key is less."""
    wanted = [total * i // cuts for i in range(1, cuts)]
    # an open boundary: the numbers of the key known so far, its interval's prefix and depth in the current number, bytes below it
    done: dict[int, tuple[int, int, int]] = {}
    open_ = {i: ((), 0, 0, 0) for i in range(len(wanted))}
    while open_:
        groups: dict[tuple, list[int]] = {}
        for i, (known, prefix, depth, below) in open_.items():
            groups.setdefault((known, prefix, depth, below), []).append(i)
        # all open intervals of one level and depth are probed by one job
        for level, depth in sorted({(len(known), depth) for known, _, depth, _ in groups}):
            own = {(k[0], k[1]): (k[3], v) for k, v in groups.items() if len(k[0]) == level and k[2] == depth}
            more = min(FIRST if depth == 0 and level == 0 else NEXT, BITS - depth)
            k = f"k{level + 1}"
            part = rows
            names = [f"k{j + 1}" for j in range(level)]
            if level or depth:
                keys = rows.sparkSession.createDataFrame([(*known, prefix) for known, prefix in own], ", ".join(f"g{j} long" for j in range(level + 1)))
                on = [F.col(n) == F.col(f"g{j}") for j, n in enumerate(names)] + [F.shiftrightunsigned(F.col(k), BITS - depth) == F.col(f"g{level}") if depth else F.lit(0) == F.col(f"g{level}")]
                part = rows.join(F.broadcast(keys), on)  # one row for each open boundary at most
            cell = F.shiftrightunsigned(F.col(k), BITS - depth - more)
            counts: dict[tuple, dict[int, int]] = {}
            for r in part.groupBy(*names, cell.alias("cell")).agg(F.sum("size").alias("bytes")).collect():
                known = tuple(r[n] for n in names)
                counts.setdefault((known, r["cell"] >> more), {})[r["cell"]] = r["bytes"]
            for (known, prefix), (below, members) in own.items():
                cells = sorted(counts.get((known, prefix), {}).items())
                edges, at = [], below
                for c, size in cells:
                    edges.append((at, c))
                    at += size
                for i in members:
                    want = wanted[i]
                    j = max(0, bisect_right([e[0] for e in edges], want) - 1)
                    low, c = edges[j]
                    high = low + dict(cells)[c]
                    if want - low <= tolerance or high - want <= tolerance or depth + more == BITS and level == 2:
                        c = c if want - low <= high - want else c + 1
                        done[i] = (*known, c << (BITS - depth - more), *([0] * (2 - level)))
                        del open_[i]
                    elif depth + more == BITS:
                        open_[i] = ((*known, c), 0, 0, low)
                    else:
                        open_[i] = (known, c, depth + more, low)
    return [done[i] for i in range(len(wanted))]


def shard(
    docs: DataFrame,
    *,
    shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_bytes: int = 8,
    tolerance: float = 0.002,
    piece_bytes: int = 256 << 20,
    most_pieces: int = 64,
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row of `docs`; the bytes of the shards are as good as equal.

    size: UTF-8 bytes of the text plus `row_bytes`; null counts as empty. A boundary is off by at most `tolerance` of
    a shard's share, or half a row if that is more. Rows of equal text share a shard unless a boundary falls among them. slot numbers
    the rows of a shard from 0 without gaps. Rows equal in id and text are interchangeable. An empty table gives no rows.

    The driver gets the histograms, at most 2^FIRST cells and then 2^NEXT for each open boundary, of which there are
    fewer than shards * most_pieces; each of these is used again by a broadcast of that size.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + row_bytes).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        _key(text).alias("k1"), _key(F.lit("id"), F.col(f"`{id_col}`")).alias("k2"), _key(F.monotonically_increasing_id()).alias("k3"),
    )
    rows = checkpoint(rows)
    total = rows.agg(F.sum("size")).first()[0] or 0
    pieces = min(most_pieces, max(1, -(-total // (shards * piece_bytes))))
    cuts = _refine(rows, total, shards * pieces, int(total / (shards * pieces) * tolerance)) if total else []
    # the boundaries by the first bits of k1: a row compares itself with those of its own cell alone
    cells: dict[int, list[tuple[int, int, int]]] = {}
    for c in cuts:
        cells.setdefault(c[0] >> (BITS - FIRST), []).append(c)
    firsts, n = [], 0
    for c in range(1 << FIRST):
        firsts.append((c, n, cells.get(c, [])))
        n += len(cells.get(c, []))
    table = docs.sparkSession.createDataFrame(firsts, "cell long, below int, cuts array<struct<k1: long, k2: long, k3: long>>")
    placed = rows.withColumn("cell", F.shiftrightunsigned("k1", BITS - FIRST)).join(F.broadcast(table), "cell")
    own = F.struct("k1", "k2", "k3")
    placed = placed.withColumn("piece", F.col("below") + F.size(F.filter("cuts", lambda c: c <= own)))
    placed = placed.select("doc_id", "size", "text_crc32", "k1", "k2", "k3", "piece", F.floor(F.col("piece") / pieces).cast("int").alias("shard"))
    counts = placed.groupBy("shard", "piece").agg(F.count("*").alias("n"))  # one row for each piece
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("piece").orderBy("k1", "k2", "k3")) - 1
    out = placed.withColumn("number", number).join(F.broadcast(starts), "piece")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("number")).cast("long").alias("slot"))
