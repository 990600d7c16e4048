"""Frames are packed in blocks, and results of a batch are handed on before all are made."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import rle


def one_by_one(plane: bytes) -> bytes:
    """PackBits byte by byte."""
    out, literal, at = bytearray(), b"", 0
    while at < len(plane) or literal:
        run = next((n for n in range(1, 128) if plane[at + n : at + n + 1] != plane[at : at + 1]), 128) if at < len(plane) else 2
        if run == 1:
            literal, at = literal + plane[at : at + 1], at + 1
            if len(literal) < 128:
                continue
        if literal:
            out += bytes([len(literal) - 1]) + literal
            literal = b""
        if run > 1 and at < len(plane):
            out += bytes([257 - run, plane[at]])
            at += run
    return bytes(out)


def test_blocks_pack_as_one(monkeypatch):
    rng = random.Random(3)
    cases = [b"", b"a", b"a" * 129, b"ab" * 64 + b"a" * 257 + b"bc"]
    cases += [b"".join(bytes([rng.randrange(3)]) * rng.choice([1, 1, 1, 2, 127, 128, 129, 130, 256, 257, 385]) for _ in range(rng.randrange(15))) for _ in range(150)]
    cases += [bytes(rng.randrange(256) for _ in range(rng.randrange(900))) for _ in range(50)]
    for block in (257, 700, 1 << 17):
        monkeypatch.setattr(rle, "BLOCK", block)
        for data in cases:
            packed = rle.pack(np.frombuffer(data, np.uint8))
            assert packed == one_by_one(data) and rle.unpack(packed, len(data)).tobytes() == data


def test_memory_of_a_long_plane_is_bounded():
    plane = (np.arange(4 << 20) * 7 % 251).astype(np.uint8)
    tracemalloc.start()
    packed = rle.pack(plane)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(packed) == len(plane) + len(plane) // 128 and peak < 40 << 20


def test_results_are_handed_on_before_the_batch_is_done(spark):
    n = 3 * rle.BATCH_BYTES // 100_000
    columns = tuple(pa.array(v, t) for v, t in (([bytes(range(250)) * 400] * n + [None, b""], pa.binary()), ([1] * (n + 2), pa.int32()), ([1] * (n + 2), pa.int32())))
    out = list(rle._each(rle.encode_frame, iter([columns, tuple(c.slice(0, 0) for c in columns)])))
    assert [v.is_valid for b in out for v in b] == [True] * n + [False, True]
    assert len(out) >= 4 and all(b.nbytes < rle.BATCH_BYTES + 200_000 for b in out)
    # through Spark each result stays at its row, whatever the batches are
    text = F.repeat(F.concat(F.lit("ab"), F.col("id").cast("string")), (F.col("id") % 7 * 3000).cast("int"))
    own = spark.range(0, 500, 1, 3).withColumn("px", F.when(F.col("id") % 11 != 0, text.cast("binary")))
    own = own.withColumn("packed", rle.rle_encode(F.col("px"))).withColumn("back", rle.rle_decode(F.col("packed"), F.octet_length("px")))
    assert own.where("back <=> px").count() == 500 and own.where("packed IS NULL").count() == 46
