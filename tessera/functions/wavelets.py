"""Wavelet pyramids of frames (ITU-T T.800, annex F): several levels of the 5/3 and 9/7 lifting over Arrow batches, sub-bands and step sizes."""

from __future__ import annotations

from math import floor, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Fixed values of the standard: the four lifting steps and the scale of the 9/7 transform.
ALPHA, BETA, GAMMA, DELTA = -1.586134342059924, -0.052980118572961, 0.882911075530934, 0.443506852043971
SCALE = 1.230174104914001

CHUNK = 1 << 21  #: samples that are transformed at once, whatever the size of a batch


def _around_odd(even: np.ndarray, n_odd: int) -> np.ndarray:
    """Sums of the even samples on both sides of each odd one; beyond the edge the last is mirrored."""
    after = np.concatenate([even[..., 1:], even[..., -1:]], -1)[..., :n_odd]
    return even[..., :n_odd] + after


def _around_even(odd: np.ndarray, n_even: int) -> np.ndarray:
    before, after = np.concatenate([odd[..., :1], odd], -1)[..., :n_even], np.concatenate([odd, odd[..., -1:]], -1)[..., :n_even]
    return before + after


def _lift(x: np.ndarray, reversible: bool) -> np.ndarray:
    """One level along the last axis: low half, then high half. A single sample stays."""
    even, odd = x[..., 0::2], x[..., 1::2]
    n_even, n_odd = even.shape[-1], odd.shape[-1]
    if n_odd == 0:
        return x
    if reversible:
        odd = odd - (_around_odd(even, n_odd) >> 1)
        even = even + ((_around_even(odd, n_even) + 2) >> 2)
        return np.concatenate([even, odd], -1)
    odd = odd + ALPHA * _around_odd(even, n_odd)
    even = even + BETA * _around_even(odd, n_even)
    odd = odd + GAMMA * _around_odd(even, n_odd)
    even = even + DELTA * _around_even(odd, n_even)
    return np.concatenate([even / SCALE, odd * SCALE], -1)


def _unlift(y: np.ndarray, reversible: bool) -> np.ndarray:
    n = y.shape[-1]
    n_even, n_odd = (n + 1) // 2, n // 2
    if n_odd == 0:
        return y
    even, odd = y[..., :n_even], y[..., n_even:]
    if reversible:
        even = even - ((_around_even(odd, n_even) + 2) >> 2)
        odd = odd + (_around_odd(even, n_odd) >> 1)
    else:
        even, odd = even * SCALE, odd / SCALE
        even = even - DELTA * _around_even(odd, n_even)
        odd = odd - GAMMA * _around_odd(even, n_odd)
        even = even - BETA * _around_even(odd, n_even)
        odd = odd - ALPHA * _around_odd(even, n_odd)
    out = np.empty_like(y)
    out[..., 0::2], out[..., 1::2] = even, odd
    return out


def _sides(rows: int, cols: int, levels: int) -> list[tuple[int, int]]:
    """Rows and columns that each level transforms, finest first, and at last those of the low band that remains."""
    if min(rows, cols) < 1 or levels < 0:
        raise ValueError("a frame has rows and columns, and levels from 0")
    out = [(rows, cols)]
    for _ in range(levels):
        out.append(((out[-1][0] + 1) // 2, (out[-1][1] + 1) // 2))
    return out


def _turned(x: np.ndarray, step, reversible: bool) -> np.ndarray:
    return step(x.swapaxes(-1, -2), reversible).swapaxes(-1, -2)


def forward(frames: np.ndarray, levels: int, reversible: bool) -> np.ndarray:
    """A stack of frames (n, rows, cols), transformed level by level, rows before columns; low bands come first in both directions."""
    out = frames.astype(np.int64 if reversible else np.float64)
    for h, w in _sides(*frames.shape[1:], levels)[:-1]:
        out[:, :h, :w] = _turned(_lift(out[:, :h, :w], reversible), _lift, reversible)
    return out


def inverse(coefficients: np.ndarray, levels: int, reversible: bool) -> np.ndarray:
    """The frames of `forward`: the same integers (5/3), or values that differ by rounding (9/7)."""
    out = coefficients.astype(np.int64 if reversible else np.float64)
    for h, w in reversed(_sides(*coefficients.shape[1:], levels)[:-1]):
        out[:, :h, :w] = _unlift(_turned(out[:, :h, :w], _unlift, reversible), reversible)
    return out


def _over_frames(values: Column, kind: str, rows: int, cols: int, change) -> Column:
    """`change` of stacks of whole frames as arrays of `kind`. Null stays null, as does an array of another length or with nulls or NaN."""
    n, out_type = rows * cols, {"int": pa.int32(), "double": pa.float64()}[kind]
    whole = (F.size(values) == n) & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")))

    @F.arrow_udf(f"array<{kind}>")
    def run(batch: pa.Array) -> pa.Array:
        there = np.asarray(batch.is_valid().to_numpy(zero_copy_only=False), bool)
        flat = batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, rows, cols)
        step = max(1, CHUNK // n)
        parts = [pa.array(change(flat[k : k + step]).reshape(-1), out_type) for k in range(0, len(flat), step)]
        ends = np.concatenate([[0], np.cumsum(there * n)])
        # a null at the place where a null row begins makes the row null
        starts = pa.array(ends.astype(np.int32), pa.int32(), mask=np.append(~there, False))
        return pa.ListArray.from_arrays(starts, pa.concat_arrays(parts) if parts else pa.array([], out_type))

    return run(F.when(whole, values))


def pyramid(samples: Column, rows: int, cols: int, levels: int, reversible: bool = True) -> Column:
    """The coefficients of a frame of rows * cols samples after `levels` levels, as an array in the same order: integers of the 5/3 transform, or
    doubles of the 9/7 one. Null stays null, as does an array of another length or with nulls. Levels beyond a side of one sample change nothing."""
    _sides(rows, cols, levels)
    return _over_frames(samples, "int" if reversible else "double", rows, cols, lambda x: forward(x, levels, reversible))


def pyramid_inverse(coefficients: Column, rows: int, cols: int, levels: int, reversible: bool = True) -> Column:
    """The samples of `pyramid`, doubles for the 9/7 transform."""
    _sides(rows, cols, levels)
    return _over_frames(coefficients, "int" if reversible else "double", rows, cols, lambda x: inverse(x, levels, reversible))


def bands(rows: int, cols: int, levels: int) -> list[tuple[str, int, int, int, int]]:
    """Sub-bands of a pyramid as (name, first row, first column, rows, columns): the low band, then HL, LH and HH of each level, finest first.
    HL is high along rows. Bands without samples are listed too."""
    sides = _sides(rows, cols, levels)
    out = [(f"LL{levels}", 0, 0, *sides[-1])]
    for level, ((h, w), (low_h, low_w)) in enumerate(zip(sides, sides[1:], strict=False), 1):
        out += [(f"HL{level}", 0, low_w, low_h, w - low_w), (f"LH{level}", low_h, 0, h - low_h, low_w), (f"HH{level}", low_h, low_w, h - low_h, w - low_w)]
    return out


def band_of(i: Column, rows: int, cols: int, levels: int) -> Column:
    """The name of the sub-band that holds place `i` of a pyramid; null outside."""
    r, c, out = F.floor(i / cols), i % cols, None
    for name, r0, c0, h, w in bands(rows, cols, levels):
        inside = (r >= r0) & (r < r0 + h) & (c >= c0) & (c < c0 + w)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def step_sizes(depth: int, levels: int, reversible: bool, guard: int = 2) -> list[tuple[int, int]]:
    """(exponent, mantissa) of each of `bands`: a step is 2^(guard - exponent) * (1 + mantissa / 2048).

    Reversible bands keep all bits, so their exponent is the depth and one more for each direction that is high. Irreversible steps are 2^-depth,
    finer by the gain of their band: 2^k for each direction that is high at level k (from 1).
    """
    if reversible:
        return [(depth, 0)] + [(depth + high, 0) for _ in range(levels) for high in (1, 1, 2)]
    gains = [1] + [2 ** (level * high) for level in range(1, levels + 1) for high in (1, 1, 2)]
    return [step_code(2.0**-depth / g, guard) for g in gains]


def step_code(step: float, guard: int) -> tuple[int, int]:
    """The exponent (0 to 31) and mantissa (0 to 2047) of a positive step."""
    if not step > 0:
        raise ValueError("a step is above 0")
    exponent = min(31, max(0, guard - floor(log2(step))))
    return exponent, min(2047, max(0, round((step / 2.0 ** (guard - exponent) - 1) * 2048)))


def step_value(code: tuple[int, int], guard: int = 2) -> float:
    return 2.0 ** (guard - code[0]) * (1 + code[1] / 2048)


def _steps(rows: int, cols: int, levels: int, depth: int, guard: int, unit: float) -> np.ndarray:
    out = np.empty((rows, cols))
    for (_, r, c, h, w), code in zip(bands(rows, cols, levels), step_sizes(depth, levels, False, guard), strict=True):
        out[r : r + h, c : c + w] = step_value(code, guard) * unit
    return out


def quantized(coefficients: Column, rows: int, cols: int, levels: int, depth: int, guard: int = 2, unit: float = 1.0) -> Column:
    """Coefficients of the 9/7 pyramid in steps of their bands, towards 0. `unit` is what a step of 1 is in samples (2^depth for samples that
    are not scaled to 0 to 1). Null as in `pyramid`; values beyond 32 bits end there."""
    steps = _steps(rows, cols, levels, depth, guard, unit)
    return _over_frames(coefficients, "int", rows, cols, lambda x: np.clip(np.sign(x) * np.floor(np.abs(x) / steps), -(2**31), 2**31 - 1).astype(np.int32))


def dequantized(values: Column, rows: int, cols: int, levels: int, depth: int, guard: int = 2, unit: float = 1.0) -> Column:
    """The middles of the steps that `quantized` gives; 0 for 0."""
    steps = _steps(rows, cols, levels, depth, guard, unit)
    return _over_frames(values, "double", rows, cols, lambda q: np.sign(q) * (np.abs(q) + 0.5) * steps * (q != 0))
