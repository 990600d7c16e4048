import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, q int, high double"


def brute(rows, k=5):
    kept = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, label, q in sorted({(i, label, tuple(q)) for i, label, q in kept if i % 100 == 0}):
        scored = sorted((-dot(q, r), i, own == label) for i, own, r in kept if i != a)
        for s, p, _ in [x for x in scored if x[2]][:k]:
            ns = [x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(ns)]
    return sorted(out)


def own(spark, rows, **how):
    df = spark.createDataFrame([(i, v, label, "clash", 1, 1.0) for i, v, label in rows], SCHEMA).repartition(3)
    out = hn.hard_negatives(df, F.col("vec_id") % 100 == 0, **how)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def vectors(rng, n, dims, copies):
    """Random rows; a share of near and exact copies of one vector."""
    hot = rng.normal(size=dims)
    rows = []
    for k in range(n):
        v = hot + rng.choice([0, 0.01]) * rng.normal(size=dims) if rng.random() < copies else rng.normal(size=dims) * rng.choice([0.1, 1, 1, 1])
        rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(4))))
    return rows


@pytest.mark.parametrize("n,dims,copies,block", [(700, 24, 0.0, 16384), (900, 9, 0.4, 6)])
def test_against_brute_force(spark, n, dims, copies, block, monkeypatch):
    monkeypatch.setattr(hn, "CELLS", 700)
    monkeypatch.setattr(hn, "PAIRS", 100)
    rows = vectors(np.random.default_rng(n), n, dims, copies)
    want = brute(rows)
    assert len(want) > 20 and own(spark, rows, block_rows=block) == want


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1) for _ in range(6)], rng.randrange(3)) for k in range(0, 120)]
    rows += [(None, [1.0] * 6, 1), (1000, None, 1), (1001, [1.0, None, 1.0], 1), (1002, [1.0] * 6, None), (1100, [math.nan] * 6, 1), (1200, [math.inf] + [0.0] * 5, 2), (1003, [1e30] * 6, 1)]
    rows += [(1300, [], 1), (1301, [3.0], 1), (1400, [2.0, 1.0], 0), (1500, [0.0] * 6, 2)]
    rows += [(0, rows[0][1], rows[0][2])] * 3 + [(55, rows[55][1], rows[55][2])] * 4 + [(100, [0.5] * 6, 9)]
    # 1e30 is finite, but its scores are no longs: the row takes no part
    assert own(spark, rows) == brute([r for r in rows if r[0] != 1003])
    assert own(spark, []) == [] and own(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert own(spark, [(0, [1.0], 1), (2, [1.0], 2)]) == [] and own(spark, [(0, [1.0], 1), (3, [-1.0], 1), (2, [1.0], 2)]) == []


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 7, 8, 9, 40]), st.sampled_from([1, 1000, 2**25]))
def test_no_pair_at_the_threshold_is_lost(seed, dims, size):
    """Candidates hold every pair that reaches its anchor's threshold, whatever the index leaves out."""
    rng = np.random.default_rng(seed)
    anchors, rows = (rng.normal(size=(n, dims)) * size * rng.choice([0.01, 1, 3], size=(n, 1)) for n in (5, 30))
    anchors, rows = np.rint(anchors).astype(np.int64), np.rint(rows).astype(np.int64)
    block = hn.Anchors(np.zeros(5, np.int64), anchors)
    scores = rows @ anchors.T
    low = np.array([np.sort(s)[-rng.integers(1, 30)] for s in scores.T]).astype(np.float64)
    longest = np.sqrt((rows.astype(float) ** 2).sum(axis=1)).max(initial=0) * (1 + hn.SLACK)
    slots = hn.indexed_slots(block.rest, low - np.abs(low) * 1e-12, longest)
    most = np.argsort(-slots, kind="stable")
    r, w = hn.candidates(block, most, (low - np.abs(low) * 1e-12)[most], slots[most], rows)
    assert {(a, b) for a, b in zip(*np.nonzero(scores >= low))} <= set(zip(r.tolist(), most[w].tolist()))


def test_the_index_leaves_out_dimensions_and_prunes():
    rng = np.random.default_rng(1)
    rows = np.rint(rng.normal(size=(400, 64)) * 0.7 ** np.arange(64) * 1000).astype(np.int64)
    block = hn.Anchors(np.zeros(20, np.int64), rows[:20])
    low = 0.9 * (rows[:20].astype(float) ** 2).sum(axis=1)
    slots = hn.indexed_slots(block.rest, low, np.sqrt((rows.astype(float) ** 2).sum(axis=1)).max())
    assert slots.max() < 8 and slots.sum() < 0.5 * 20 * 8
    most = np.argsort(-slots)
    assert len(hn.candidates(block, most, low[most], slots[most], rows)[0]) < 0.1 * 400 * 20
