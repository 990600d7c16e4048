"""PNG files of 8-bit grey, RGB and RGBA frames as Arrow functions."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the format: samples of a pixel by colour type.
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def write_png(pixels: bytes, rows: int, cols: int, samples: int) -> bytes:
    colour = {1: 0, 3: 2, 4: 6}[samples]
    lines = np.zeros((rows, 1 + cols * samples), np.uint8)
    lines[:, 1:] = np.frombuffer(pixels, np.uint8).reshape(rows, cols * samples)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", cols, rows, 8, colour, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes())) + _chunk(b"IEND", b"")


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    out = line.astype(np.int64)
    for k in range(len(out)):
        a, b, c = (int(out[k - step]) if k >= step else 0), int(above[k]), (int(above[k - step]) if k >= step else 0)
        if kind == 1:
            guess = a
        elif kind == 3:
            guess = (a + b) // 2
        else:
            guess = min((a, b, c), key=lambda v: abs(a + b - c - v))
        out[k] = (out[k] + guess) & 255
    return out.astype(np.uint8)


def read_png(data: bytes) -> tuple[int, int, int, bytes]:
    """(rows, columns, samples, pixels) of an 8-bit image that isn't interlaced; alpha is dropped. Others are errors."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, packed, head = 8, b"", None
    while at + 8 <= len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif name == b"IDAT":
            packed += part
        at += 12 + n
    cols, rows, depth, colour, _, _, interlaced = head or (0, 0, 0, 9, 0, 0, 0)
    if depth != 8 or colour not in SAMPLES or interlaced:
        raise ValueError("only 8-bit grey and colour images that aren't interlaced are read")
    samples = SAMPLES[colour]
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(rows, 1 + cols * samples)
    out, above = np.zeros((rows, cols * samples), np.uint8), np.zeros(cols * samples, np.uint8)
    for r in range(rows):
        above = out[r] = _unfiltered(int(lines[r, 0]), lines[r, 1:], above, samples)
    keep = {4: 1, 6: 3}.get(colour, samples)
    return rows, cols, keep, out.reshape(rows, cols, samples)[:, :, :keep].tobytes()


def png_encode(pixels: Column, rows: int, cols: int, samples: int = 1) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda p: None if p is None else write_png(bytes(p), rows, cols, samples))

    return run(pixels)


def png_decode(data: Column) -> Column:
    """struct(rows, cols, samples, pixels); null where the file can't be read."""

    @F.pandas_udf("rows int, cols int, samples int, pixels binary")
    def run(s: pd.Series) -> pd.DataFrame:
        def one(d):
            try:
                return read_png(bytes(d)) if d is not None else (None,) * 4
            except (ValueError, struct.error, zlib.error):
                return (None,) * 4

        return pd.DataFrame([one(d) for d in s], columns=["rows", "cols", "samples", "pixels"])

    return run(data)
