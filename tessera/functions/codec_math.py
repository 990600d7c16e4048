"""Arithmetic of the lossless image codecs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often it is named in lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def med_predictor(a: Column, b: Column, c: Column) -> Column:
    """JPEG-LS median edge detector: a left, b above, c above left."""
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(c >= high, low).when(c <= low, high).otherwise(a + b - c)


def quantized_gradient(d: Column, t1: int, t2: int, t3: int, near: int = 0) -> Column:
    out = F.when(d <= -t3, -4).when(d <= -t2, -3).when(d <= -t1, -2).when(d < -near, -1).when(d <= near, 0)
    return out.when(d < t1, 1).when(d < t2, 2).when(d < t3, 3).otherwise(4)


def context_id(q1: Column, q2: Column, q3: Column) -> Column:
    return (q1 * 9 + q2) * 9 + q3


def mapped_error(e: Column) -> Column:
    """Signed errors to 0, 1, 2, ...: 0, -1, 1, -2, ..."""
    return F.when(e >= 0, 2 * e).otherwise(-2 * e - 1)


def unmapped_error(m: Column) -> Column:
    return F.when(m % 2 == 0, F.floor(m / 2)).otherwise(-F.floor((m + 1) / 2)).cast("int")


def golomb_bits(mapped: Column, k: int, limit: int, qbpp: int) -> Column:
    """Length of the limited Golomb-Rice code of a mapped error."""
    high = F.shiftright(mapped, k)
    return F.when(high < limit - qbpp - 1, high + 1 + k).otherwise(limit)


def jpeg_ls_defaults(max_val: int, near: int = 0) -> dict[str, int]:
    """Thresholds and traits of the JPEG-LS standard for samples up to `max_val`."""
    keep = lambda v, low: low if v < low or v > max_val else v
    if max_val >= 128:
        f = (min(max_val, 4095) + 128) // 256
        t1, t2, t3 = f + 2 + 3 * near, f * 4 + 3 + 5 * near, f * 17 + 4 + 7 * near
    else:
        f = 256 // (max_val + 1)
        t1, t2, t3 = max(2, 3 // f + 3 * near), max(3, 7 // f + 5 * near), max(4, 21 // f + 7 * near)
    t1 = keep(t1, near + 1)
    t2 = keep(t2, t1)
    t3 = keep(t3, t2)
    span = (max_val + 2 * near) // (2 * near + 1) + 1
    bpp = max(2, max_val.bit_length())
    return {"t1": t1, "t2": t2, "t3": t3, "range": span, "bpp": bpp, "qbpp": (span - 1).bit_length(), "limit": 2 * (bpp + max(8, bpp))}


def lossless_predictor(selection: int, a: Column, b: Column, c: Column) -> Column:
    """Predictors 1 to 7 of lossless JPEG: a left, b above, c above left."""
    return {
        1: a, 2: b, 3: c, 4: a + b - c, 5: a + F.floor((b - c) / 2).cast("int"), 6: b + F.floor((a - c) / 2).cast("int"), 7: F.floor((a + b) / 2).cast("int"),
    }[selection]


def reversible_colour(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return F.floor((r + 2 * g + b) / 4).cast("int"), b - g, r - g


def reversible_colour_inverse(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    g = (y - F.floor((cb + cr) / 4)).cast("int")
    return cr + g, g, cb + g


def irreversible_colour(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return 0.299 * r + 0.587 * g + 0.114 * b, -0.16875 * r - 0.33126 * g + 0.5 * b, 0.5 * r - 0.41869 * g - 0.08131 * b


def dead_zone(c: Column, step: float) -> Column:
    return (F.signum(c) * F.floor(F.abs(c) / step)).cast("int")


def wavelet_53(samples: Column, n: int) -> Column:
    """One level of the reversible 5/3 lifting of an array of n samples: low half, then high half. Edges are mirrored."""
    mirror = lambda i: F.when(i < 0, -i).when(i > n - 1, 2 * (n - 1) - i).otherwise(i).cast("int")
    x = lambda i: F.get(samples, mirror(i))
    if n == 1:
        return samples
    high = lambda k: x(2 * k + 1) - F.floor((x(2 * k) + x(2 * k + 2)) / 2).cast("int")
    n_low, n_high = (n + 1) // 2, n // 2
    highs = F.transform(F.sequence(F.lit(0), F.lit(n_high - 1)), high)

    def both(highs: Column) -> Column:
        # high coefficients beyond the edges mirror as their samples do: -1 -> 0, n_high -> n_high - 1
        d = lambda k: F.get(highs, F.greatest(F.lit(0), F.least(F.lit(n_high - 1), k)).cast("int"))
        lows = F.transform(F.sequence(F.lit(0), F.lit(n_low - 1)), lambda k: x(2 * k) + F.floor((d(k - 1) + d(k) + 2) / 4).cast("int"))
        return F.concat(lows, highs)

    return let(highs, both)


def wavelet_53_inverse(coefficients: Column, n: int) -> Column:
    """The samples of one level of `wavelet_53`."""
    return coefficients if n == 1 else let(coefficients, lambda c: _samples_of(c, n))


def _samples_of(coefficients: Column, n: int) -> Column:
    n_low, n_high = (n + 1) // 2, n // 2
    d = lambda k: F.get(coefficients, (n_low + F.greatest(F.lit(0), F.least(F.lit(n_high - 1), k))).cast("int"))
    even = lambda k: F.get(coefficients, k.cast("int")) - F.floor((d(k - 1) + d(k) + 2) / 4).cast("int")
    evens = F.transform(F.sequence(F.lit(0), F.lit(n_low - 1)), even)

    def sample(pair: Column, i: Column) -> Column:
        k = F.floor(i / 2).cast("int")
        x = lambda j: F.get(pair, F.least(j, F.lit(n_low - 1)).cast("int"))
        odd = d(k) + F.floor((x(k) + F.when(2 * k + 2 > n - 1, x(k)).otherwise(x(k + 1))) / 2).cast("int")
        return F.when(i % 2 == 0, x(k)).otherwise(odd)

    return let(evens, lambda e: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: sample(e, i)))


def transposed(samples: Column, rows: int, cols: int) -> Column:
    """An array of rows * cols samples, row by row, as one of its columns."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda i: F.get(samples, ((i % rows) * cols + F.floor(i / rows)).cast("int")))


def along_rows(samples: Column, rows: int, cols: int, change) -> Column:
    """`change` of every row of an array of rows * cols samples."""
    return let(samples, lambda x: F.flatten(F.array(*[change(F.slice(x, r * cols + 1, cols)) for r in range(rows)])))


def wavelet_53_frame(samples: Column, rows: int, cols: int) -> Column:
    """One level of the 5/3 transform in two dimensions, rows first. A null array, or one of another length, is null or holds nulls."""
    across = along_rows(samples, rows, cols, lambda r: wavelet_53(r, cols))
    down = let(across, lambda x: along_rows(transposed(x, rows, cols), cols, rows, lambda c: wavelet_53(c, rows)))
    return let(down, lambda x: transposed(x, cols, rows))


def wavelet_53_frame_inverse(coefficients: Column, rows: int, cols: int) -> Column:
    """The samples of `wavelet_53_frame`."""
    up = let(coefficients, lambda x: along_rows(transposed(x, rows, cols), cols, rows, lambda c: wavelet_53_inverse(c, rows)))
    return let(up, lambda x: along_rows(transposed(x, cols, rows), rows, cols, lambda r: wavelet_53_inverse(r, cols)))


def modular_difference(sample: Column, prediction: Column) -> Column:
    """Sample less prediction, modulo 2^16 within -32767 to 32768 (lossless JPEG)."""
    d = sample - prediction
    return F.when(d <= -32768, d + 65536).when(d > 32768, d - 65536).otherwise(d)


def difference_code(d: Column) -> tuple[Column, Column]:
    """(category, additional bits) of a difference in lossless JPEG: the category is its number of bits, 16 for 32768, which has no bits more."""
    size = F.when(d == 32768, 16).when(d == 0, 0).otherwise(F.length(F.bin(F.abs(d).cast("long"))))
    bits = F.when((d == 32768) | (d == 0), 0).when(d > 0, d).otherwise(d + F.call_function("shiftleft", F.lit(1), size) - 1)
    return size.cast("int"), bits.cast("int")


def quantized_error(e: Column, near: int) -> Column:
    """A prediction error in steps of 2 near + 1, rounded to the nearest (JPEG-LS)."""
    step = F.floor((F.abs(e) + near) / (2 * near + 1)).cast("int")
    return e if near == 0 else F.when(e > 0, step).otherwise(-step)


def modulo_error(e: Column, span: int) -> Column:
    """An error within -span/2 and (span - 1)/2, modulo `span`."""
    up = F.when(e < 0, e + span).otherwise(e)
    return F.when(up >= (span + 1) // 2, up - span).otherwise(up)


def reconstructed(prediction: Column, error: Column, near: int, span: int, max_val: int) -> Column:
    """The sample that a prediction and a quantized error give, within 0 and `max_val`."""
    v = prediction + error * (2 * near + 1)
    v = F.when(v < -near, v + span * (2 * near + 1)).when(v > max_val + near, v - span * (2 * near + 1)).otherwise(v)
    return F.greatest(F.lit(0), F.least(F.lit(max_val), v))


def golomb_parameter(n: Column, a: Column) -> Column:
    """The least k for which n 2^k reaches a: the parameter of the Golomb code in a context that was met n times with errors of sum a."""
    return F.get(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda k: n.cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), k) >= a), F.lit(0))
