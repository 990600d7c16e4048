"""Pyramids of wavelets: inverses for all sides, a plain per-sample lifting, sub-bands that cover the frame, and step sizes."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.functions import wavelets


def by_sample(x, reversible):
    """One level of a list, sample by sample, with whole-sample mirroring."""
    n, y = len(x), [float(v) if not reversible else int(v) for v in x]
    if n == 1:
        return y
    at = lambda i: y[-i if i < 0 else 2 * (n - 1) - i if i > n - 1 else i]
    if reversible:
        for i in range(1, n, 2):
            y[i] -= (at(i - 1) + at(i + 1)) // 2
        for i in range(0, n, 2):
            y[i] += (at(i - 1) + at(i + 1) + 2) // 4
        return y[0::2] + y[1::2]
    for first, by in ((1, wavelets.ALPHA), (0, wavelets.BETA), (1, wavelets.GAMMA), (0, wavelets.DELTA)):
        for i in range(first, n, 2):
            y[i] += by * (at(i - 1) + at(i + 1))
    return [v / wavelets.SCALE for v in y[0::2]] + [v * wavelets.SCALE for v in y[1::2]]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 13), st.integers(1, 13), st.integers(0, 5), st.booleans(), st.integers(0, 2**32 - 1))
def test_levels_and_inverse(rows, cols, levels, reversible, seed):
    x = np.random.default_rng(seed).integers(-4096, 4096, (3, rows, cols))
    y = wavelets.forward(x, levels, reversible)
    back = wavelets.inverse(y, levels, reversible)
    assert (back == x).all() if reversible else np.allclose(back, x, atol=1e-6)
    want, h, w = [list(map(list, f)) for f in x.tolist()], rows, cols
    for f in want:
        h, w = rows, cols
        for _ in range(levels):
            for r in range(h):
                f[r][:w] = by_sample(f[r][:w], reversible)
            for c in range(w):
                for r, v in enumerate(by_sample([f[r][c] for r in range(h)], reversible)):
                    f[r][c] = v
            h, w = (h + 1) // 2, (w + 1) // 2
    assert np.array_equal(y, want) if reversible else np.allclose(y, want, atol=1e-6)


def test_a_flat_frame_is_its_low_band():
    for reversible in (True, False):
        y = wavelets.forward(np.full((1, 9, 6), 700), 3, reversible)
        names = {n: y[0, r : r + h, c : c + w] for n, r, c, h, w in wavelets.bands(9, 6, 3)}
        assert np.allclose(names.pop("LL3"), 700, atol=1e-6) and all(np.allclose(v, 0, atol=1e-6) for v in names.values())


@pytest.mark.parametrize("rows,cols,levels", [(1, 1, 2), (7, 5, 3), (8, 8, 0), (16, 3, 4)])
def test_bands_cover_each_place_once(spark, rows, cols, levels):
    seen = np.zeros((rows, cols), int)
    for _, r, c, h, w in wavelets.bands(rows, cols, levels):
        seen[r : r + h, c : c + w] += 1
    assert (seen == 1).all()
    named = spark.range(rows * cols + 1).select(wavelets.band_of(F.col("id"), rows, cols, levels).alias("b")).collect()
    assert [r.b is None for r in named] == [False] * (rows * cols) + [True]


def test_step_sizes():
    assert wavelets.step_sizes(12, 2, True) == [(12, 0), (13, 0), (13, 0), (14, 0), (13, 0), (13, 0), (14, 0)]
    assert [wavelets.step_value(s) for s in wavelets.step_sizes(8, 2, False)] == [2.0**-e for e in (8, 9, 9, 10, 10, 10, 12)]
    assert wavelets.step_code(0.75, 2) == (3, 1024) and wavelets.step_value((3, 1024)) == 0.75
    with pytest.raises(ValueError):
        wavelets.step_code(0.0, 2)


def test_columns_in_batches_with_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    frames = [rng.integers(0, 4096, 35).tolist() for _ in range(25)]
    odd = [None, [], frames[0][:34], [*frames[0][:34], None]]
    rows = [(k, v) for k, v in enumerate([odd[0], *frames, *odd[1:], frames[1]])]
    own = spark.createDataFrame(rows, "k int, px array<int>").coalesce(1)
    y53, y97 = wavelets.pyramid(F.col("px"), 7, 5, 3), wavelets.pyramid(F.col("px"), 7, 5, 3, reversible=False)
    own = own.select("k", "px", y53.alias("y"), y97.alias("z"))
    back = wavelets.dequantized(wavelets.quantized(F.col("z"), 7, 5, 3, 12, unit=4096.0), 7, 5, 3, 12, unit=4096.0)
    out = own.select("*", wavelets.pyramid_inverse(F.col("y"), 7, 5, 3).alias("x"), wavelets.pyramid_inverse(F.col("z"), 7, 5, 3, False).alias("v"), back.alias("b")).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.px is None or len(r.px) != 35 or None in r.px:
            assert r.y is r.z is r.x is r.v is r.b is None
        else:
            assert r.y == wavelets.forward(np.array(r.px).reshape(1, 7, 5), 3, True).ravel().tolist()
            assert r.x == r.px and np.allclose(r.v, r.px, atol=1e-6) and np.abs(np.array(r.b) - r.z).max() <= 1.0
    none = spark.createDataFrame([], "px array<int>").select(y53.alias("y")).collect()
    assert none == []
