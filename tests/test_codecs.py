import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera import queries
from tessera.functions import rle
from tessera.operators import codecs, datasets

RLE_UID, EXPLICIT = "1.2.840.10008.1.2.5", "1.2.840.10008.1.2.1"
SCHEMA = "id int, uid string, pixels binary, rows int, cols int, samples int, bits_allocated int, bits_stored int"


def rows(spark, cases):
    return spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], SCHEMA)


def test_objects_go_to_their_codec_and_back(spark):
    px = bytearray(bytes([7] * 5 + [1, 2, 3]) * 2)
    cases = [(RLE_UID, px, 4, 4, 1, 8, 8), (EXPLICIT, px, 2, 4, 1, 16, 12), (RLE_UID, px, 2, 4, 1, 16, 16), (RLE_UID, px[:12], 2, 2, 3, 8, 8)]
    df = codecs.decoded(codecs.encoded(rows(spark, cases), codecs.BUILT_IN), codecs.BUILT_IN).orderBy("id").collect()
    assert [(bytes(r.pixels), r.codec, r.error) for r in df] == [(bytes(c[1]), "native" if c[0] == EXPLICIT else "rle", None) for c in cases]
    assert bytes(df[1].data) == bytes(px) and len(df[0].data) < 64 + len(px) + 2


def test_what_cannot_be_coded_is_an_error_row(spark):
    px = bytearray(16)
    cases = [("1.2.3", px, 4, 4, 1, 8, 8), (None, px, 4, 4, 1, 8, 8), (EXPLICIT, px, 4, 4, 1, 8, 0), (EXPLICIT, px, 4, 4, 1, 8, 9), (EXPLICIT, px, 4, 4, 1, 8, None), (EXPLICIT, px, 5, 4, 1, 8, 8), (EXPLICIT, None, 4, 4, 1, 8, 8), (RLE_UID, px, 4, 4, 1, 8, 8), (RLE_UID, bytearray(b"x" * 99), 4, 4, 1, 8, 8)]
    out = codecs.decoded(rows(spark, cases).withColumnRenamed("pixels", "data"), codecs.BUILT_IN).orderBy("id").collect()
    low, over, bad = "BitsStored must be at least 1", "BitsStored exceeds BitsAllocated", "the data can't be coded"
    assert [r.error for r in out] == ["no codec for 1.2.3", "no codec for no transfer syntax", low, over, low, bad, bad, bad, bad] and all(r.pixels is None for r in out)
    assert [r.error for r in codecs.decoded(rows(spark, cases[:1]).withColumnRenamed("pixels", "data"), []).collect()] == ["no codec for 1.2.3"]


def test_the_last_registered_counts(spark):
    mark = lambda name: (lambda data: F.concat(F.lit(name.encode()), data))
    first = codecs.Codec("first", ("a", "b"), ("a", "b"), mark("1"), mark("1"))
    second = codecs.Codec("second", ("b", "c"), ("c",), mark("2"), mark("2"))
    table = {r.uid: (r.decoder, r.encoder, r.codec) for r in codecs.registry(spark, [first, second]).collect()}
    # what does both directions is the last that does both, as b is only read by the second
    assert table == {"a": ("first", "first", "first"), "b": ("second", "first", "first"), "c": ("second", "second", "second")}
    own = rows(spark, [(u, bytearray(b"x"), 1, 1, 1, 8, 8) for u in "abc"])
    assert [bytes(r.data) for r in codecs.encoded(own, [first, second]).orderBy("id").collect()] == [b"1x", b"1x", b"2x"]
    assert [bytes(r.out) for r in codecs.decoded(own, [second, first], data="pixels", out="out").orderBy("id").collect()] == [b"1x", b"1x", b"2x"]


def vectors(spark, folder, values):
    """Each value as the sixth of 64, once in every kind of frame; None is no vector."""
    plain = [(k * 37 % 64 - 32) / 80 for k in range(64)]
    own = [v if v is None else [*plain[:5], float(v), *plain[6:]] for v in values for _ in range(6)]
    spark.createDataFrame(list(enumerate(own)), "vec_id long, embedding array<float>").withColumn("label", F.lit(0)).write.parquet(f"{folder}/embeddings.parquet")
    return queries.codec_dispatch(spark, str(folder)).orderBy("vec_id").collect()


@pytest.mark.parametrize(
    "values",
    [
        pytest.param([-0.6001, -0.62, -0.7996], id="shades below 0 are cut towards 0"),
        pytest.param([np.nextafter(np.float32(b), np.float32(s)) for b in (-0.6, -0.4, -0.2, 0.2, 0.4, 0.6, 0.8) for s in (-9, b, 9)], id="values are of single precision"),
        pytest.param([1e6, 2e15], id="values are long"),
        pytest.param([None], id="no vector is no error"),
    ],
)
def test_dispatched_frames_equal_the_sql(spark, tmp_path, values):
    out = vectors(spark, tmp_path, values)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    own = con.execute(queries.SQL["codec_dispatch"] + " ORDER BY vec_id")
    names = [d[0] for d in own.description]
    assert [tuple(r[n] for n in names) for r in out] == own.fetchall()


def test_values_that_are_no_long_and_shades_below_0(spark, tmp_path):
    """The SQL fails there, or writes eight bytes for a sample."""
    out = vectors(spark, tmp_path, [float("nan"), float("inf"), -1e30, -0.85, -1.0])
    bad, fixed = "the data can't be coded", ["no codec for 1.2.3.4", "BitsStored exceeds BitsAllocated", "BitsStored must be at least 1"]
    assert [r.error for r in out] == ([bad, bad, *fixed, bad] * 3 + [None, None, *fixed, None] * 2) and all(r.pixels is None for r in out[:18])
    assert [r.pixels[10:12] if r.pixels else None for r in out[18:]] == ["FF", "FF", None, None, None, "FF", "FE", "FE", None, None, None, "FE"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 300)), max_size=8), st.integers(1, 3), st.integers(1, 2))
def test_run_lengths(runs, samples, width):
    px = b"".join(bytes([v]) * n for v, n in runs)
    px = px[: len(px) // (samples * width) * samples * width]
    frame = rle.encode_frame(px, samples, width)
    assert rle.decode_frame(frame, len(px) // (samples * width), samples, width) == px
    assert len(frame) <= 64 + len(px) * 129 // 128 + 4 * samples * width
    assert np.frombuffer(frame[:4], "<u4")[0] == samples * width


def test_fragments_are_numbered_without_their_bytes(spark):
    rows_ = [("f", k // 3, k % 3, bytes([k]) * (k + 1)) for k in range(7)] + [("f", 9, 0, b"same"), ("f", 9, 0, b"same"), ("f", 9, 0, b"same"), ("g", None, None, None), ("g", None, None, b"z")]
    df = spark.createDataFrame([(f, a, b, None if c is None else bytearray(c)) for f, a, b, c in rows_], "file string, frame int, ord int, data binary").repartition(3)
    out = datasets.encapsulated(df, "file", "frame", "ord", "data")
    got = {f: [bytes(r.b) for r in sorted((r for r in out.collect() if r.file == f), key=lambda r: int(r.path.split("/")[1]))] for f in "fg"}
    assert got["f"][1:8] == [c for _, _, _, c in rows_[:7]] and got["f"][8:] == [b"same"] * 3 and sorted(got["g"][1:]) == [b"", b"z"]
    paths = sorted(r.path for r in out.where("file = 'f'").collect())
    assert paths == sorted(f"7FE00010/{k}" for k in range(11))
    # no window over a file's fragments holds their bytes
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [k for k, line in enumerate(plan) if "Window [" in line and "windowspecdefinition(file#" in line and "copies" not in plan[k + 1]]
    assert windows and all(" b#" not in plan[k + 1].split("Project")[-1].split("+-")[0] for k in windows if "Project" in plan[k + 1])
