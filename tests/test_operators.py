import struct
from datetime import date, timedelta

import pytest

from pyspark.sql import functions as F

from tessera.functions import matching, pixels, values
from tessera.operators import datasets, dictionary, frames, negotiation, query_retrieve
from tessera.queries import archive
from tessera.sources import dicom_json, part10
from tessera.streaming import messages


def element(tag, vr, value, **how):
    return part10.encoded(tag, vr, value, **how)


def file_of(body, syntax="1.2.840.10008.1.2.1", preamble=True):
    meta = element(0x00020010, "UI", syntax.encode())
    head = element(0x00020000, "UL", struct.pack("<I", len(meta))) + meta
    return (b"\0" * 128 + b"DICM" if preamble else b"") + head + body


def parsed(spark, files, tags=None):
    df = spark.createDataFrame([(k, bytearray(c) if c is not None else None) for k, c in files.items()], "file string, content binary")
    out = {}
    for r in part10.parse_elements(df, "file", "content", tags).collect():
        out.setdefault(r.file, {})[r.path] = r
    return out


def test_parsing(spark):
    us = struct.pack("<H", 512)
    item = element(0x00100020, "LO", b"ABCD", explicit=False)
    nested = b"\xfe\xff\x00\xe0" + struct.pack("<I", len(element(0x00100020, "LO", b"IT"))) + element(0x00100020, "LO", b"IT")
    sequence = struct.pack("<HH", 0x0008, 0x1115) + b"SQ\0\0" + struct.pack("<I", len(nested)) + nested
    unknown = struct.pack("<HH", 0x7777, 0x0010) + b"UN\0\0\xff\xff\xff\xff" + b"\xfe\xff\x00\xe0\xff\xff\xff\xff" + item + b"\xfe\xff\x0d\xe0\0\0\0\0" + b"\xfe\xff\xdd\xe0\0\0\0\0"
    pixels = struct.pack("<HH", 0x7FE0, 0x0010) + b"OB\0\0\xff\xff\xff\xff" + b"\xfe\xff\x00\xe0\0\0\0\0" + b"\xfe\xff\x00\xe0\2\0\0\0\x12\x34" + b"\xfe\xff\xdd\xe0\0\0\0\0"
    got = parsed(spark, {
        "plain": file_of(element(0x00080005, "CS", b"ISO_IR 100") + element(0x00100010, "PN", "Müller^Hans".encode("latin-1")) + element(0x00280010, "US", us) + element(0x00280030, "DS", b"2.78\\3")),
        "no preamble": file_of(element(0x00280010, "US", us), preamble=False),
        "big endian": file_of(element(0x00280010, "US", b"\2\0", little=False), "1.2.840.10008.1.2.2"),
        "implicit": element(0x00280010, "US", us, explicit=False),
        "nested": file_of(sequence), "unknown": file_of(unknown), "fragments": file_of(pixels),
        "cut": file_of(element(0x00280010, "US", us))[:-1], "empty": b"", "null": None, "deep": file_of(b""),
    })
    assert got["plain"]["00100010"].s == ["Müller^Hans"] and got["plain"]["00280030"].s == ["2.78", "3"]
    for name in ("plain", "no preamble", "big endian", "implicit"):
        assert [int(x) for x in got[name]["00280010"].i] == [512], name
    assert got["nested"]["00081115/0/00100020"].s == ["IT"] and got["nested"]["00081115/0/00100020"].depth == 1
    assert got["unknown"]["77770010"].vr == "SQ" and got["unknown"]["77770010/0/00100020"].s == ["ABCD"]
    assert bytes(got["fragments"]["7FE00010/1"].b) == b"\x12\x34"
    assert None in got["cut"] and got["cut"][None].error
    assert "empty" not in got and "null" not in got
    pruned = parsed(spark, {"a": file_of(pixels + b"")}, tags=[0x00280010])
    assert pruned == {}


def test_binary_files_are_scanned(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.dcm").write_bytes(file_of(element(0x00100020, "LO", f"P{k}".encode()) + element(0x00280010, "US", struct.pack("<H", k))))
    rows = part10.instances(part10.read_elements(spark, str(tmp_path)), ["PatientID", "Rows"]).collect()
    assert sorted((r.PatientID, r.Rows) for r in rows) == [(f"P{k}", str(k)) for k in range(3)]


def test_json_and_xml(spark):
    rows = [("f", "00100010", 0, 0x00100010, "PN", ["Müller^\"Hans\""], None, None, None, None), ("f", "00280010", 0, 0x00280010, "US", None, [512], None, None, None), ("f", "00100020", 0, 0x00100020, "LO", None, None, None, None, None), ("f", "7FE00010", 0, 0x7FE00010, "OB", None, None, None, bytearray(b"\x12\x34"), None)]
    from decimal import Decimal

    rows = [(*r[:6], r[6] and [Decimal(x) for x in r[6]], *r[7:]) for r in rows]
    df = spark.createDataFrame(rows, part10.ELEMENTS)
    text = dicom_json.to_json(df).first().json
    assert text == '{"00100010":{"vr":"PN","Value":[{"Alphabetic":"Müller^\\"Hans\\""}]},"00100020":{"vr":"LO"},"00280010":{"vr":"US","Value":[512]},"7FE00010":{"vr":"OB","InlineBinary":"EjQ="}}'
    bulk = dicom_json.to_json(df, bulk_uri=F.lit("http://x/1")).first().json
    assert '"7FE00010":{"vr":"OB","BulkDataURI":"http://x/1"}' in bulk
    back = {r.tag: r for r in dicom_json.from_json(spark.createDataFrame([("f", text)], "file string, json string")).collect()}
    assert back[0x00280010].value == ["512"] and bytes(back[0x7FE00010].inline) == b"\x12\x34"
    xml = dicom_json.to_xml(df).first().xml
    assert '<DicomAttribute tag="00100020" vr="LO"/>' in xml and "<GivenName>&quot;Hans&quot;</GivenName>" in xml


def test_frames(spark):
    fragments = spark.createDataFrame([("a", 0, "xx", 2), ("a", 1, "yyyy", 4), ("a", 2, "zzz", 3)], "img string, i int, data string, n long")
    table = spark.createDataFrame([("a", 0, 0), ("a", 1, 22)], "img string, frame int, offset long")
    out = frames.frames_by_offsets(fragments, table, ["img"], ["i"], F.col("n"))
    assert sorted((r.i, r.offset, r.frame) for r in out.collect()) == [(0, 0, 0), (1, 10, 0), (2, 22, 1)]
    joined = frames.assemble(out, ["img", "frame"], "i", "data").collect()
    assert sorted((r.frame, len(r.data)) for r in joined) == [(0, 6), (1, 3)]
    text = spark.createDataFrame([(1, "abcdefghij"), (2, "")], "id int, t string")
    rows = sorted((r.id, r.chunk, r.data, r.is_last) for r in frames.chunks(text, ["id"], F.col("t"), 16).collect())
    assert rows == [(1, 0, "abcd", False), (1, 1, "efgh", False), (1, 2, "ij", True), (2, 0, "", True)]
    assert frames.chunks(text, ["id"], F.col("t"), 0).count() == 2 and frames.chunk_length(5) == 1


def test_negotiation_and_lookups(spark):
    contexts = spark.createDataFrame([(1, "ct", ["b", "a"]), (3, "ct", ["c"]), (5, "mr", ["a"])], "id int, abs string, ts array<string>")
    out = negotiation.negotiate(contexts, spark.createDataFrame([("ct",)], "abs string"), "abs", "ts", F.array(F.lit("a"), F.lit("b")))
    assert sorted((r.id, r.result, r.transfer_syntax) for r in out.collect()) == [(1, 0, "a"), (3, 4, None), (5, 3, None)]
    tags = spark.createDataFrame([(0x00100010,), (0x60020010,), (0x00090010,), (0x00080000,), (0x00181234,)], "tag long")
    got = {r.tag: r.vr for r in dictionary.with_entry(tags, "tag").collect()}
    assert got == {0x00100010: "PN", 0x60020010: "US", 0x00090010: "LO", 0x00080000: "UL", 0x00181234: "UN"}
    table = spark.createDataFrame([("STORE ", "h1", 1), ("store", "h2", 2)], "name string, host string, k int")
    asked = spark.createDataFrame([(1, " Store"), (2, "other"), (3, None)], "id int, title string")
    out = query_retrieve.destinations(asked, "title", table, "name", "k")
    assert sorted((r.id, r.host, r.status) for r in out.collect()) == [(1, "h1", 0), (2, None, 0xA801), (3, None, 0xA801)]


def test_stream_is_stored_once(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "service string, n int"
    spark.createDataFrame([("echo", 1), ("find", 2)], schema).write.parquet(source)
    providers = spark.createDataFrame([("echo", 0)], "service string, status int")
    stream = messages.message_stream(spark, source, spark.read.parquet(source).schema)
    out = messages.run_available(stream, str(tmp_path), lambda b: messages.answered(b, providers, "service"))
    assert sorted((r.service, r.status) for r in out.collect()) == [("echo", 0), ("find", 0x0211)]
    counts = messages.windowed_counts(spark.createDataFrame([("2024-01-01 01:00:00", "a"), ("2024-01-01 02:00:00", "a")], "ts string, s string").withColumn("ts", F.to_timestamp("ts")), "ts", "s")
    assert [r.n for r in counts.collect()] == [2]


def test_messages_span_batches(spark, tmp_path):
    """Half a message in the first file, the rest in the second; each file is a micro-batch of its own."""
    source, schema = str(tmp_path / "pdvs"), "a long, seq long, d string, last boolean"
    for rows in ([(1, 0, "x", False), (2, 0, "p", True)], [(1, 2, "z", True), (1, 1, "y", False), (2, 1, "q", False)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(source)
    out = messages.run_available(messages.assembled(stream, "a", "seq", "d", "last"), str(tmp_path))
    assert sorted((r.association, r.message, r.parts, r.data) for r in out.collect()) == [(1, 0, 3, "xyz"), (2, 0, 1, "p")]


def test_nested_items_come_back(spark):
    """Items, empty ones and items of items, as files in every syntax and as JSON."""
    rows = [("00081115", 0, "SQ", None), ("00081115/0", 1, "", None), ("00081115/0/00081140", 1, "SQ", None), ("00081115/0/00081140/0", 2, "", None), ("00081115/0/00081140/0/00081150", 2, "UI", ["1.3"]), ("00081115/0/00081155", 1, "UI", ["1.2"]), ("00081115/1", 1, "", None), ("00100010", 0, "PN", ["A^B=C=D"])]
    tag = lambda p, vr: dicom_json.ITEM if vr == "" else int(p[-8:], 16)
    df = spark.createDataFrame([("f", p, d, tag(p, vr), vr, s, None, None, None, None) for p, d, vr, s in rows], part10.ELEMENTS)
    for syntax in ("1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99"):
        got = part10.parse_elements(part10.write_content(df, syntax), "file", "content").where("tag > 196608 AND tag != 524293").collect()
        assert [(r.path, r.depth, r.vr, r.s) for r in got] == rows
    text = dicom_json.to_json(df)
    assert text.first().json == '{"00081115":{"vr":"SQ","Value":[{"00081140":{"vr":"SQ","Value":[{"00081150":{"vr":"UI","Value":["1.3"]}}]},"00081155":{"vr":"UI","Value":["1.2"]}},{}]},"00100010":{"vr":"PN","Value":[{"Alphabetic":"A^B","Ideographic":"C","Phonetic":"D"}]}}'
    back = dicom_json.from_json(text).collect()
    assert sorted((r.path, r.depth, r.vr, r.value) for r in back) == sorted(rows)
    assert dicom_json.from_json(spark.createDataFrame([("f", None), ("g", "no json")], "file string, json string")).count() == 0


def test_fragments_are_written(spark):
    rows = [("f", f"7FE00010/{k}", 0, 0x7FE00010, "OB", None, None, None, bytearray(x), None) for k, x in enumerate((b"", b"abc", b"de"))]
    df = spark.createDataFrame(rows, part10.ELEMENTS)
    got = part10.parse_elements(part10.write_content(df, "1.2.840.10008.1.2.5"), "file", "content").where("tag = 2145386512").collect()
    assert [(r.path, bytes(r.b or b"")) for r in got] == [("7FE00010/0", b""), ("7FE00010/1", b"abc\0"), ("7FE00010/2", b"de")]
    assert dicom_json.to_json(df).first().json == '{"7FE00010":{"vr":"OB"}}'


def test_ranges_keep_repeated_rows(spark):
    ranges = spark.createDataFrame([(1, 10, 0, "small"), (8, 25, 1, "middle"), (None, 3, 2, "none")], "low int, high int, entry int, band string")
    df = spark.createDataFrame([(1, 9), (1, 9), (2, 20), (3, None), (4, 99)], "k int, v int").withColumn("band", F.lit("own"))
    got = sorted((r.k, r.band) for r in dictionary.range_lookup(df, "v", ranges, "low", "high", "entry").collect())
    assert got == [(1, "small"), (1, "small"), (2, "middle"), (3, None), (4, None)]


@pytest.mark.parametrize("key", ["1997", "19970304", "1997.03.04", "-1997", "1997-", "199702-19970331", "19970231-", "-19970231", "-199713", "199700-199712", "x-1997", "-", ""])
def test_typed_dates_match_as_text_does(spark, key):
    days = [date(1996, 12, 31) + timedelta(days=k) for k in range(0, 460, 3)] + [date(1997, 1, 1), date(1997, 2, 28), date(1997, 3, 1), date(1997, 3, 4), None]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = df.select(F.coalesce(matching.typed_date_range(F.col("d"), key), F.lit(False)).alias("typed"), matching.date_range(F.date_format("d", "yyyyMMdd"), key).alias("text")).collect()
    assert [r.typed for r in got] == [r.text for r in got]


def test_typed_keys_reach_the_scan(spark, sf_dir):
    studies = archive(spark, sf_dir).studies
    plan = lambda keys: query_retrieve.matched(studies, keys)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan({"StudyDate": "1996-"}) and "LessThan(o_orderdate" in plan({"StudyDate": "-1997"})
    assert "In(o_orderkey" in plan({"StudyInstanceUID": "1\\5"}) and "StringStartsWith(o_orderpriority" in plan({"StudyDescription": "1*"})


def test_paths_and_editing(spark):
    rows = [("00081115", 0, "SQ", None), ("00081115/0", 1, "", None), ("00081115/0/00081155", 1, "UI", ["1.2"]), ("00100010", 0, "PN", ["A"])]
    tag = lambda p, vr: dicom_json.ITEM if vr == "" else int(p[-8:], 16)
    df = spark.createDataFrame([("f", p, d, tag(p, vr), vr, s, None, None, None, None) for p, d, vr, s in rows], part10.ELEMENTS)
    asked = [("f", "/00081115/00/00081155/"), ("f", "00081115/0/00081155"), ("f", "0008111"), ("f", None), ("f", "00081115/1/00081155"), ("g", "00100010"), (None, "00100010"), ("f", "00081115/0/00081155/0/00100010")]
    got = {(r.file, r.path): (r.status, r.n_items) for r in datasets.resolve(df, spark.createDataFrame(asked, "file string, path string")).collect()}
    want = ["found", "found", "invalid", "invalid", "out of range", "no element", "no element", "not a sequence"]
    assert [got[a][0] for a in asked] == want and got["f", "00081115/1/00081155"][1] == 1
    put = datasets.with_value(df, "00081115/0/00081155", "UI", s=F.array(F.lit("9")))
    assert sorted((r.path, r.depth, r.s and r.s[0]) for r in put.collect()) == [("00081115", 0, None), ("00081115/0", 1, None), ("00081115/0/00081155", 1, "9"), ("00100010", 0, "A")]
    assert datasets.with_value(df, "00081115/7/00081155", "UI").count() == 4
    assert [r.path for r in datasets.removed(df, "00081115").collect()] == ["00100010"]
    assert datasets.summary(df.limit(0)).count() == 0 and datasets.summary(df).first().n_elements == 2
    with pytest.raises(ValueError):
        datasets.removed(df, "x")


def test_private_blocks_and_uid_names(spark):
    rows = [("f", "00090010", 0x00090010, ["ACME"]), ("f", "00091001", 0x00091001, ["x"]), ("f", "00091101", 0x00091101, ["y"]), ("f", "00081115/0/00091001", 0x00091001, ["z"]), ("g", "00091001", 0x00091001, ["w"])]
    df = spark.createDataFrame(rows, "file string, path string, tag long, s array<string>")
    entries = spark.createDataFrame([("ACME", 9, 1, "LO", "Widget")], "creator string, group int, element int, vr string, keyword string")
    got = {(r.file, r.path): r.private_keyword for r in dictionary.with_private_entry(df, entries).collect()}
    assert len(got) == 5 and {k for k, v in got.items() if v} == {("f", "00091001")}
    uids = spark.createDataFrame([("1.2.840.10008.1.1\0",), ("1.2.840.10008.1.2",), ("1.9",), (None,)], "u string")
    assert [r.uid_name for r in dictionary.with_uid_name(uids, "u").collect()] == ["Verification SOP Class", "Implicit VR Little Endian", None, None]


def test_values_and_photometric(spark):
    own = spark.createDataFrame([(1.5,), (100.0,), (1.0 / 3,), (-1.23456789012e-30,), (float("nan"),)], "v double")
    assert [r[0] for r in own.select(values.format_ds(F.col("v"))).collect()] == ["1.5", "100", "3.333333E-01", "-1.234568E-30", "0"]
    kinds = spark.createDataFrame([(" monochrome1 ",), ("YBR_FULL",), ("HSV",), (None,)], "p string").select(pixels.photometric(F.col("p")).alias("p")).collect()
    assert [tuple(r.p) for r in kinds] == [("MONOCHROME1", True, 1), ("YBR_FULL", False, 3), (None, False, None), (None, False, None)]
