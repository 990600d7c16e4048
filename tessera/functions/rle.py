"""RLE Lossless frames: PackBits segments, one for each byte of each sample, as Arrow functions over binary columns."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


#: Bytes of a plane that are packed at once, and of values read and made after which results are handed on.
BLOCK, BATCH_BYTES = 1 << 17, 2 << 20


def _packed(plane: np.ndarray, whole: bool) -> tuple[np.ndarray, int]:
    """(packed bytes, bytes of the plane they hold). Unless the plane is whole its last run or literal may go on, and is left: packing from there gives the same."""
    n = len(plane)
    starts = np.flatnonzero(np.r_[True, plane[1:] != plane[:-1]])
    runs = np.diff(starts, append=n)
    # single bytes, and what is one byte too much for a run's last part
    literal = np.zeros(n, bool)
    ends = starts + runs - 1
    literal[ends[runs % 128 == 1]] = True
    # parts begin where a run or a sequence of literals does, and 128 bytes on
    begins = np.r_[True, (plane[1:] != plane[:-1]) & ~(literal[1:] & literal[:-1]) | (literal[1:] != literal[:-1])]
    first = np.flatnonzero(begins)
    counts = -(-np.diff(first, append=n) // 128)
    at = np.repeat(first, counts) + 128 * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    sizes, done = np.diff(at, append=n), n
    if not whole:
        done = int(at[-1])
        at, sizes, plane, literal = at[:-1], sizes[:-1], plane[:done], literal[:done]
    single = literal[at]
    kept = literal.copy()
    kept[at] = True
    out = np.empty(int(kept.sum()) + len(at), np.uint8)
    control = np.cumsum(np.where(single, sizes, 1) + 1) - np.where(single, sizes, 1) - 1
    values = np.ones(len(out), bool)
    values[control] = False
    out[control] = np.where(single, sizes - 1, 257 - sizes)
    out[values] = plane[kept]
    return out, done


def pack(plane: np.ndarray) -> bytes:
    """PackBits: runs of at least two equal bytes (at most 128), literals of at most 128 in between."""
    out, at = [], 0
    while at < len(plane):
        packed, done = _packed(plane[at : at + BLOCK], at + BLOCK >= len(plane))
        out.append(packed.tobytes())
        at += done
    return b"".join(out)


def unpack(data: bytes, size: int) -> np.ndarray:
    """Inverse of `pack`, up to `size` bytes; what is missing is 0."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        control = data[at]
        if control < 128:
            out += data[at + 1 : at + 2 + control]
            at += control + 2
        elif control > 128:
            out += data[at + 1 : at + 2] * (257 - control)
            at += 2
        else:
            at += 1
    return np.frombuffer(bytes(out[:size]).ljust(size, b"\0"), np.uint8)


def encode_frame(pixels: bytes, samples: int, width: int) -> bytes:
    """A frame of interleaved little-endian samples of `width` bytes: header of 64 bytes and a segment for each byte, high ones first."""
    planes = np.frombuffer(pixels, np.uint8).reshape(-1, samples * width)
    segments = []
    for s in range(samples):
        for b in reversed(range(width)):
            segment = pack(planes[:, s * width + b])
            segments.append(segment + b"\0" * (len(segment) % 2))
    offsets = np.cumsum([64, *map(len, segments)])[:-1].tolist()
    return struct.pack("<16I", len(segments), *offsets, *[0] * (15 - len(offsets))) + b"".join(segments)


def decode_frame(frame: bytes, n_pixels: int, samples: int, width: int) -> bytes:
    n, *offsets = struct.unpack("<16I", frame[:64])
    if n != samples * width or any(o < 64 or o > len(frame) for o in offsets[:n]):
        raise ValueError("the header doesn't fit the frame")
    ends = [*offsets[1:n], len(frame)]
    out = np.zeros((n_pixels, samples * width), np.uint8)
    for k in range(n):
        out[:, k // width * width + width - 1 - k % width] = unpack(frame[offsets[k] : ends[k]], n_pixels)
    return out.tobytes()


def _each(fn, batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """One result for each row, null where an argument is null or the row can't be coded. Bytes are looked at where the batch has them; results
    are handed on every `BATCH_BYTES`, so those of a whole batch are never held."""

    def one(row):
        if not all(v.is_valid for v in row):
            return None
        try:
            return fn(*[v.as_buffer() if isinstance(v, pa.BinaryScalar | pa.LargeBinaryScalar) else v.as_py() for v in row])
        except (ValueError, struct.error):
            return None

    for columns in batches:
        held, size = [], 0
        for row in zip(*columns, strict=True):
            held.append(one(row))
            size += len(held[-1] or b"")
            if size >= BATCH_BYTES:
                yield pa.array(held, pa.binary())
                held, size = [], 0
        yield pa.array(held, pa.binary())


def _column(value: Column | int) -> Column:
    return F.lit(value) if isinstance(value, int) else value.cast("int")


def rle_encode(pixels: Column, samples: Column | int = 1, width: Column | int = 1) -> Column:
    """A frame of interleaved samples of `width` bytes; null for null, and where the bytes aren't whole pixels."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return _each(encode_frame, batches)

    return run(pixels, _column(samples), _column(width))


def rle_decode(frame: Column, n_pixels: Column, samples: Column | int = 1, width: Column | int = 1) -> Column:
    """Pixels of a frame; null where it can't be decoded."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return _each(lambda data, *shape: decode_frame(data.to_pybytes(), *shape), batches)

    return run(frame, n_pixels.cast("long"), _column(samples), _column(width))
