import base64
import json
import math

import pytest

from tessera.sources import dicom_json, json_elements as je, part10


def read(spark, objects):
    df = spark.createDataFrame([(str(k), x if x is None or isinstance(x, str) else json.dumps(x)) for k, x in enumerate(objects)], "file string, json string")
    out = {}
    for r in je.read_json(df).collect():
        out.setdefault(int(r.file), []).append(r)
    return out


def one(vr, *values, **more):
    return {"00181234": {"vr": vr, "Value": list(values), **more}}


#: (element, its column and values) and (element, its error)
GOOD = [
    (one("US", 512, "0", 65535), ("i", [512, 0, 65535])), (one("SS", -32768), ("i", [-32768])), (one("UV", 2**64 - 1), ("i", [2**64 - 1])), (one("SV", -(2**63)), ("i", [-(2**63)])),
    (one("OW", "7"), ("i", [7])), (one("UL", 2**32 - 1), ("i", [2**32 - 1])), (one("IS", 12, "-7"), ("s", ["12", "-7"])), (one("DS", "1.5e3", 2), ("s", ["1.5e3", "2"])),
    (one("FD", 0.1, "-2.5"), ("f", [0.1, -2.5])), (one("FL", "inf"), ("f", [math.inf])), (one("AT", "00100020", "7FE00010"), ("i", [0x00100020, 0x7FE00010])), (one("AT", "00100020", 5, None), ("i", [0x00100020])),
    (one("LO", "a", None, 3), ("s", ["a", "", "3"])), (one("LO", ""), ("s", [""])), (one("PN", {"Alphabetic": "A^B", "Phonetic": "C"}, None), ("s", ["A^B==C", ""])), (one("PN", {"Alphabetic": 3}), ("s", [""])),
    (one("DA", "20240131", "2024"), ("s", ["20240131", "2024"])), (one("TM", "2359"), ("s", ["2359"])), (one("DT", "20240131120000.5+0100"), ("s", ["20240131120000.5+0100"])), (one("UI", "1.2", "1.3"), ("s", ["1.2"])),
    (one("US", None, ""), (None, None)), (one("DA", None), (None, None)), (one("UI"), (None, None)), ({"00181234": {"vr": "US"}}, (None, None)), (one("SQ"), (None, None)),
    ({"00181234": {"vr": "OB", "InlineBinary": base64.b64encode(b"\1\2\3").decode()}}, ("b", b"\1\2\3")), ({"0018abcd": {"vr": "SH", "Value": ["lower"]}}, ("s", ["lower"])),
]
BAD = [
    (one("US", 1, None), je.MIXED), (one("IS", "", "4"), je.MIXED), (one("DA", "2024", None), je.MIXED), (one("UI", "1.2", ""), je.MIXED), (one("DS", None, 1), je.MIXED),
    (one("US", 65536), je.OUT_OF_RANGE), (one("US", -1), je.OUT_OF_RANGE), (one("SS", 32768), je.OUT_OF_RANGE), (one("SL", 2**31), je.OUT_OF_RANGE), (one("IS", 2**63), je.OUT_OF_RANGE), (one("UV", "99999999999999999999999999999999999999999"), je.OUT_OF_RANGE),
    (one("US", "twelve"), je.BAD_NUMBER), (one("US", 1.5), je.BAD_NUMBER), (one("IS", "1e3"), je.BAD_NUMBER), (one("FD", "1d"), je.BAD_NUMBER), (one("DS", " 1"), je.BAD_NUMBER),
    (one("US", {"a": 1}), je.BAD_KIND), (one("LO", True), je.BAD_KIND), (one("LO", ["x"]), je.BAD_KIND), (one("PN", "A^B"), je.BAD_KIND), (one("SQ", "x"), je.BAD_ITEM), (one("SQ", {}, None), je.BAD_ITEM),
    (one("DA", "20241"), je.BAD_DATE), (one("TM", "2500"), je.BAD_DATE), (one("DT", "x"), je.BAD_DATE), (one("AT", "0010002"), je.BAD_AT), (one("AT", "0010GGGG"), je.BAD_AT),
    ({"00181234": {"Value": ["x"]}}, je.NO_VR), ({"00181234": {"vr": 5}}, je.NO_VR), ({"00181234": {"vr": "ZZ"}}, je.UNKNOWN_VR), ({"00181234": "x"}, je.NO_OBJECT), ({"00181234": None}, je.NO_OBJECT),
    ({"00100": {"vr": "LO"}}, je.BAD_TAG), ({"GGGGEEEE": {"vr": "LO"}}, je.BAD_TAG), ({"00181234": {"vr": "LO", "Value": "x"}}, je.NO_ARRAY), ({"00181234": {"vr": "LO", "Value": None}}, je.NO_ARRAY),
    ({"00181234": {"vr": "OB", "InlineBinary": "%%"}}, je.BAD_BASE64), ({"00181234": {"vr": "OB", "InlineBinary": 1}}, je.BAD_BASE64), ({"00181234": {"vr": "OB", "BulkDataURI": "http://x"}}, je.NO_LOADER),
    ("not json", je.NO_JSON), (None, je.NO_JSON), ("[]", je.NO_OBJECT), ("3", je.NO_OBJECT), ("", je.NO_JSON),
]


@pytest.fixture(scope="module")
def cases(spark):
    # beside each element another one, which an error must not take away
    beside = lambda x: {**x, "00100020": {"vr": "LO", "Value": ["beside"]}} if isinstance(x, dict) else x
    return read(spark, [beside(x) for x, _ in [*GOOD, *BAD]])


@pytest.mark.parametrize("k", range(len(GOOD)), ids=lambda k: json.dumps(GOOD[k][0])[:60])
def test_values(cases, k):
    (row, other) = sorted(cases[k], key=lambda r: r.s == ["beside"])
    assert row.error is None and other.s == ["beside"]
    column, values = GOOD[k][1]
    got = {c: row[c] for c in ("s", "i", "f", "b") if row[c] is not None}
    assert ({c: bytes(v) if c == "b" else [float(x) if c == "f" else x for x in v] for c, v in got.items()}) == ({} if column is None else {column: values})


@pytest.mark.parametrize("k", range(len(BAD)), ids=lambda k: json.dumps(BAD[k][0])[:60])
def test_errors(cases, k):
    rows = cases[len(GOOD) + k]
    (bad,) = [r for r in rows if r.error]
    assert bad.error == BAD[k][1] and bad.s is None and bad.i is None and bad.f is None and bad.b is None
    assert len(rows) == (2 if isinstance(BAD[k][0], dict) else 1)


def test_no_depth_is_cut(spark):
    deep = {"00100020": {"vr": "LO", "Value": ["at 40"]}}
    for _ in range(40):
        deep = {"00081115": {"vr": "SQ", "Value": [deep, {}]}}
    rows = read(spark, [deep])[0]
    assert max(r.depth for r in rows) == 40 and len(rows) == 40 + 80 + 1
    (last,) = [r for r in rows if r.s]
    assert last.path == "00081115/0/" * 40 + "00100020"
    df = spark.createDataFrame([("f", json.dumps(deep))], "file string, json string").coalesce(1)
    assert sorted(r.path for r in dicom_json.from_json(df).collect()) == sorted(r.path for r in rows)


def test_rows_are_those_of_files(spark):
    """Read from JSON, written as files and parsed again: the same rows."""
    objects = {k: {"00080018": {"vr": "UI", "Value": [f"1.2.{k}"]}, "00100010": {"vr": "PN", "Value": [{"Alphabetic": "Ä^B"}]}, "00280010": {"vr": "US", "Value": [k]}, "00081115": {"vr": "SQ", "Value": [{"00181149": {"vr": "IS", "Value": [k, 5]}}]}, "00189073": {"vr": "FD", "Value": [k / 7]}} for k in range(5)}
    df = spark.createDataFrame([(str(k), json.dumps(x)) for k, x in objects.items()], "file string, json string")
    own = je.read_json(df)
    assert own.columns == [f.split()[0] for f in part10.ELEMENTS.split(", ")]
    back = part10.parse_elements(part10.write_content(own), "file", "content").where("tag > 196608 AND tag != 524293")
    plain = lambda rows: sorted((r.file, r.path, r.depth, r.tag, r.vr, str(r.s), str(r.i), str(r.f)) for r in rows)
    assert plain(back.collect()) == plain(own.collect())
    assert je.read_json(df.limit(0)).count() == 0
