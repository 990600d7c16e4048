"""The pixel pipeline as Column expressions over single samples and arrays of samples."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def modality(stored: Column, slope, intercept) -> Column:
    return stored * F.lit(slope) + F.lit(intercept)


def mask_unsigned(p: Column, stored: int, high_bit: int) -> Column:
    return F.shiftright(p, high_bit + 1 - stored).bitwiseAND(2**stored - 1)


def mask_signed(p: Column, stored: int, high_bit: int) -> Column:
    """The stored bits as a signed number; 16 stored bits are unchanged."""
    if stored == 16:
        return p
    raw = mask_unsigned(p, stored, high_bit)
    return F.when(raw >= 2 ** (stored - 1), raw - 2**stored).otherwise(raw)


def window(v: Column, center: Column, width: Column, low: float = 0.0, high: float = 255.0) -> Column:
    """The linear VOI function, rounded and clamped to whole grey values."""
    w = F.greatest(width, F.lit(1.0))
    lower, upper = center - 0.5 - (w - 1) / 2, center - 0.5 + (w - 1) / 2
    scaled = ((v - (center - 0.5)) / F.when(w > 1, w - 1) + 0.5) * (high - low) + low
    return clamp(F.round(F.when(v <= lower, low).when(v > upper, high).otherwise(scaled)), 0, 255).cast("int")


def fallback_window(low: Column, high: Column) -> tuple[Column, Column]:
    """(center, width) from the least and greatest value of a frame."""
    flat = low >= high
    return F.when(flat, low + 0.5).otherwise((low + high) / 2), F.when(flat, 1.0).otherwise(F.greatest(high - low, F.lit(1.0)))


def grey(v: Column, center: Column, width: Column, inverted: bool = False) -> Column:
    out = window(v, center, width)
    return 255 - out if inverted else out


def palette_index(index: Column, first: int, n: int) -> Column:
    return clamp(index - first, 0, n - 1)


def palette_entry(table: Column, index: Column, first: int, n: int, bits: int) -> Column:
    entry = F.element_at(table, (palette_index(index, first, n) + 1).cast("int"))
    return F.shiftright(entry, 8) if bits > 8 else entry


def ybr_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """BT.601 full range."""
    b, r = cb - 128.0, cr - 128.0
    whole = lambda c: clamp(F.round(c), 0, 255).cast("int")
    return whole(y + 1.402 * r), whole(y - 0.344136 * b - 0.714136 * r), whole(y + 1.772 * b)


def planar_to_interleaved(planes: Column, n: int, channels: int = 3) -> Column:
    """Samples plane by plane to samples pixel by pixel; missing samples are 0."""
    at = F.sequence(F.lit(0), F.lit(n * channels - 1))
    return F.transform(at, lambda i: F.coalesce(F.get(planes, ((i % channels) * n + F.floor(i / channels)).cast("int")), F.lit(0)))


def interleaved_to_planar(samples: Column, n: int, channels: int = 3) -> Column:
    at = F.sequence(F.lit(0), F.lit(n * channels - 1))
    return F.transform(at, lambda i: F.coalesce(F.get(samples, ((i % n) * channels + F.floor(i / n)).cast("int")), F.lit(0)))


def rotated(pixels: Column, rows: int, cols: int, degrees: int) -> Column:
    """Clockwise by 0, 90, 180 or 270 degrees."""
    out_cols = rows if degrees in (90, 270) else cols
    at = F.sequence(F.lit(0), F.lit(rows * cols - 1))

    def source(i: Column) -> Column:
        r, c = F.floor(i / out_cols), i % out_cols
        row, col = {0: (r, c), 90: (rows - 1 - c, r), 180: (rows - 1 - r, cols - 1 - c), 270: (c, cols - 1 - r)}[degrees]
        return F.get(pixels, (row * cols + col).cast("int"))

    return F.transform(at, source)


def flipped(pixels: Column, rows: int, cols: int, horizontal: bool, vertical: bool) -> Column:
    at = F.sequence(F.lit(0), F.lit(rows * cols - 1))

    def source(i: Column) -> Column:
        r, c = F.floor(i / cols), i % cols
        return F.get(pixels, ((rows - 1 - r if vertical else r) * cols + (cols - 1 - c if horizontal else c)).cast("int"))

    return F.transform(at, source)


def crop_bounds(rows: int, cols: int, top: float, left: float, height: float, width: float) -> tuple[int, int, int, int]:
    """(first row, end row, first column, end column) of a region given in shares of the image."""
    from math import ceil, floor

    if not all(0 <= x <= 1 for x in (top, left, height, width, top + height, left + width)):
        raise ValueError("a region lies within 0 and 1")
    return floor(top * rows), ceil((top + height) * rows), floor(left * cols), ceil((left + width) * cols)


def cropped(pixels: Column, rows: int, cols: int, top: float, left: float, height: float, width: float) -> Column:
    r0, r1, c0, c1 = crop_bounds(rows, cols, top, left, height, width)
    return F.flatten(F.array(*[F.slice(pixels, r * cols + c0 + 1, c1 - c0) for r in range(r0, r1)]))


def scaled_side(given: int, other: int, own: int) -> int:
    """The missing side of an image scaled so that its aspect is kept."""
    return max(1, (other * given + own // 2) // own)


def bilinear(pixels: Column, rows: int, cols: int, new_rows: int, new_cols: int) -> Column:
    """Bilinear scaling between pixel centres."""

    def axis(i: Column, new: int, old: int):
        at = F.greatest((i + 0.5) * old / new - 0.5, F.lit(0.0))
        low = F.floor(at)
        return low, F.least(low + 1, F.lit(old - 1)), at - low

    def value(i: Column) -> Column:
        r0, r1, fr = axis(F.floor(i / new_cols), new_rows, rows)
        c0, c1, fc = axis(i % new_cols, new_cols, cols)
        p = lambda r, c: F.get(pixels, (r * cols + c).cast("int"))
        mixed = (p(r0, c0) * (1 - fc) + p(r0, c1) * fc) * (1 - fr) + (p(r1, c0) * (1 - fc) + p(r1, c1) * fc) * fr
        return clamp(F.round(mixed), 0, 255).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(new_rows * new_cols - 1)), value)


def overlay_bit(packed: Column, row: Column, col: Column, rows: int, cols: int) -> Column:
    """Bit (row, col) of a packed plane, from the lowest bit up; false outside. packed: array of byte values."""
    at = row * cols + col
    inside = (row >= 0) & (row < rows) & (col >= 0) & (col < cols)
    byte = F.get(packed, F.floor(at / 8).cast("int"))
    return F.when(inside, F.getbit(byte.cast("long"), (at % 8).cast("int")) == 1).otherwise(False)


def ybr_422_to_rgb(samples: Column) -> Column:
    """Array of r, g, b of pairs of pixels stored as Cb, Y, Cr, Y; samples behind the last whole group are left out, as they are no pixel."""
    groups = F.sequence(F.lit(0), F.floor(F.size(samples) / 4).cast("int") - 1)
    at = lambda g, k: F.get(samples, g * 4 + k).cast("double")
    pair = lambda g: F.array(*ybr_to_rgb(at(g, 1), at(g, 0), at(g, 2)), *ybr_to_rgb(at(g, 3), at(g, 0), at(g, 2)))
    return F.when(F.size(samples) >= 4, F.flatten(F.transform(groups, pair))).otherwise(F.array().cast("array<int>"))


#: Fixed values of the standard (PS3.3 C.7.6.3.1.2): photometric interpretations by kind, and their channels once rendered.
GREYSCALE, COLOUR = ["MONOCHROME1", "MONOCHROME2"], ["RGB", "PALETTE COLOR", "YBR_FULL", "YBR_FULL_422", "YBR_ICT", "YBR_RCT"]


def photometric(c: Column) -> Column:
    """struct(name, greyscale, channels) of a photometric interpretation, blanks and case aside; name null where it is none of those known."""
    name = F.upper(F.trim(c))
    known = F.when(name.isin(GREYSCALE + COLOUR), name)
    return F.struct(known.alias("name"), F.coalesce(name.isin(GREYSCALE), F.lit(False)).alias("greyscale"), F.when(name.isin(GREYSCALE), 1).when(name.isin(COLOUR), 3).alias("channels"))


def normalised(grey: Column) -> Column:
    """Grey values 0 to 255 as shares from 0 to 1."""
    return grey / 255.0
