import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import pdu, png
from tessera.operators import images
from tessera.sources import dicom_source, files, part10
from tests.test_operators import element, file_of


def test_files_are_stored_and_scanned(spark, tmp_path):
    content = {k: file_of(element(0x00100020, "LO", f"P{k}".encode()) + element(0x00280010, "US", struct.pack("<H", k))) for k in range(5)}
    df = spark.createDataFrame([(k, "1.2/3" if k < 2 else f"1.2.{k}", bytearray(c)) for k, c in content.items()], "k int, uid string, content binary")
    named = files.file_names(df, "uid", "k")
    folder = f"file://{tmp_path}/store"
    assert files.save_files(named, folder) == 5 and files.save_files(named, folder) == 5
    assert sorted(p.name for p in (tmp_path / "store").iterdir()) == ["1.2.2.dcm", "1.2.3.dcm", "1.2.4.dcm", "1.2_3-1.dcm", "1.2_3.dcm"]
    dicom_source.register(spark)
    scanned = spark.read.format("dicom").option("tags", "00100020").option("filesPerPartition", "2").load(folder)
    assert scanned.rdd.getNumPartitions() == 3
    assert sorted(r.s[0] for r in scanned.collect()) == [f"P{k}" for k in range(5)]
    assert files.save_files(named.limit(0), folder) == 0


def test_units(spark):
    body = F.unhex(F.lit("0000000401034142" + "00000003010243" + "000000FF0101"))
    r = spark.range(1).select(pdu.pdvs(body).alias("p"), pdu.pdvs(F.lit(b"")).alias("none"), pdu.body(F.lit(bytes([4, 0, 0, 0, 0, 9, 1]))).alias("cut")).first()
    assert [(p.context, p.control, bytes(p.data)) for p in r.p] == [(1, 3, b"AB"), (1, 2, b"C")] and r.none == [] and r.cut is None
    r = spark.range(1).select(pdu.big_endian(F.lit(258), 4).alias("b"), pdu.little_endian(F.lit(258), 4).alias("l"), pdu.framed(pdu.RELEASE_RQ, F.lit(b"\0\0\0\0")).alias("f")).first()
    assert (bytes(r.b), bytes(r.l), bytes(r.f)) == (b"\0\0\1\2", b"\2\1\0\0", b"\5\0\0\0\0\4\0\0\0\0")


def test_png():
    for samples in (1, 3):
        data = bytes(range(24)) * samples
        assert png.read_png(png.write_png(data, 4, 6, samples)) == (4, 6, samples, data)
    # each filter: the same picture whatever its lines are filtered with
    rows, cols = 5, 4
    picture = [[(7 * r + 13 * c * c) % 256 for c in range(cols)] for r in range(rows)]
    lines = b""
    for r, kind in enumerate((0, 1, 2, 3, 4)):
        above = picture[r - 1] if r else [0] * cols
        out = []
        for c in range(cols):
            a, b, d = (picture[r][c - 1] if c else 0), above[c], (above[c - 1] if c else 0)
            guess = [0, a, b, (a + b) // 2, min((a, b, d), key=lambda v: abs(a + b - d - v))][kind]
            out.append((picture[r][c] - guess) % 256)
        lines += bytes([kind, *out])
    file = png.SIGNATURE + png._chunk(b"IHDR", struct.pack(">IIBBBBB", cols, rows, 8, 0, 0, 0, 0)) + png._chunk(b"IDAT", zlib.compress(lines)) + png._chunk(b"IEND", b"")
    assert png.read_png(file)[3] == bytes(v for row in picture for v in row)
    for bad in (b"", b"GIF89a", file.replace(struct.pack(">IIB", cols, rows, 8), struct.pack(">IIB", cols, rows, 16))):
        with pytest.raises(ValueError):
            png.read_png(bad)


def test_image_module(spark):
    whole = element(0x00280010, "US", b"\2\0") + element(0x00280011, "US", b"\2\0") + element(0x00280100, "US", b"\x08\0") + element(0x00281053, "DS", b" 2 ") + element(0x7FE00010, "OB", b"\1\2\3\4")
    df = spark.createDataFrame([("a", bytearray(file_of(whole))), ("b", bytearray(file_of(element(0x00280010, "US", b"\2\0"))))], "file string, content binary")
    elements = part10.parse_elements(df, "file", "content")
    got = {r.file: r for r in images.image_module(elements).collect()}
    assert (got["a"].slope, got["a"].intercept, got["a"].bits_stored, got["a"].high_bit, got["a"].frames, got["a"].error) == (2.0, 0.0, 8, 7, 1, None)
    assert got["b"].error == "cols, bits_allocated"
    frames = images.frame_bytes(images.image_module(elements)).select(images.stored_values(F.col("pixels"), F.col("bits_allocated"), F.col("signed")).alias("v")).collect()
    assert [r.v for r in frames] == [[1, 2, 3, 4]]
    overlay = element(0x60000010, "US", b"\1\0") + element(0x60020010, "US", b"\1\0") + element(0x60020011, "US", b"\1\0")
    groups = images.overlay_groups(part10.parse_elements(spark.createDataFrame([("o", bytearray(file_of(overlay)))], "file string, content binary"), "file", "content"))
    assert groups.first().groups == [0x6000, 0x6002]
