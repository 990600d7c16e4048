import struct

import pytest
from pyspark.sql import functions as F

from tessera.operators import sketches
from tessera.sources import part10
from tests.test_operators import element

IMPLICIT, EXPLICIT, BIG = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2"


def data(explicit=True, little=True, more=b""):
    how = {"explicit": explicit, "little": little}
    item = element(0x00100020, "LO", b"IN", **how)
    order = "<" if little else ">"
    sequence = struct.pack(order + "HHI", 0xFFFE, 0xE000, len(item)) + item
    return element(0x00081115, "SQ", sequence, **how) + element(0x00100020, "LO", b"P1", **how) + element(0x00280010, "US", struct.pack(order + "H", 9), **how) + more


@pytest.mark.parametrize("said,content,read", [
    (EXPLICIT, data(), EXPLICIT), (EXPLICIT, data(explicit=False), IMPLICIT), (IMPLICIT, data(), EXPLICIT), (IMPLICIT, data(explicit=False), IMPLICIT),
    (BIG, data(little=False), BIG), (BIG, data(explicit=False), IMPLICIT), ("1.2.3", data(explicit=False), IMPLICIT), (EXPLICIT, b"", EXPLICIT),
])
def test_the_syntax_that_reads_it(said, content, read):
    rows, _, chosen = part10.parse_payload(content, said)
    assert chosen == read and [r[0] for r in rows] == (["00081115", "00081115/0", "00081115/0/00100020", "00100020", "00280010"] if content else [])


@pytest.mark.parametrize("content", [b"garbage that is no data set", data()[:-1], data(explicit=False)[:-1], data(more=element(0x00100020, "LO", b"P2")), b"\x10\x00\x20\x00LO"])
def test_what_neither_reads_raises_what_was_wrong_first(content):
    with pytest.raises((ValueError, struct.error)) as first:
        part10.StrictParser(content, True, True, None).rows(0, len(content)) and part10.parse_payload(content, EXPLICIT)
    with pytest.raises((ValueError, struct.error)) as both:
        part10.parse_payload(content, EXPLICIT)
    assert str(both.value) == str(first.value)


def test_payload_rows(spark):
    rows = [("a", data(), EXPLICIT), ("b", data(explicit=False), EXPLICIT + "\0"), ("c", b"garbage", IMPLICIT), ("d", None, EXPLICIT), ("e", data(), None)]
    df = spark.createDataFrame([(f, None if c is None else bytearray(c), s) for f, c, s in rows], "file string, content binary, said string").repartition(2)
    got = {}
    for r in part10.payload_elements(df, "file", "content", "said").collect():
        got.setdefault(r.file, []).append(r)
    assert {f: {r.syntax for r in rs} for f, rs in got.items()} == {"a": {EXPLICIT}, "b": {IMPLICIT}, "c": {None}, "e": {EXPLICIT}}
    assert [r.error is not None and r.path is None for r in got["c"]] == [True]
    assert [(r.path, r.s, r.i and [int(x) for x in r.i]) for r in got["b"]] == [("00081115", None, None), ("00081115/0", None, None), ("00081115/0/00100020", ["IN"], None), ("00100020", ["P1"], None), ("00280010", None, [9])]
    pruned = part10.payload_elements(df, "file", "content", "said", [0x00280010]).where("file = 'a' AND vr != 'SQ' AND vr != ''").collect()
    assert [r.path for r in pruned] == ["00280010"]


def test_sketches_merge_to_what_all_rows_give(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 10 > 0, F.floor(F.sqrt("id") * 40).cast("long")).alias("v"), (F.col("id") % 7).alias("batch"))
    kept = None
    for b in range(7):
        own = sketches.sketched(df.where(F.col("batch") == b), ["g"], "v")
        kept = own if kept is None else sketches.merged(kept, own, ["g"])
    got = {r.g: r for r in sketches.estimated(kept, ["g"]).collect()}
    direct = {r.g: r for r in sketches.estimated(sketches.sketched(df, ["g"], "v"), ["g"]).collect()}
    twice = {r.g: r for r in sketches.estimated(sketches.merged(kept, kept, ["g"]), ["g"]).collect()}
    for r in df.groupBy("g").agg(F.countDistinct("v").alias("n"), F.count("*").alias("rows")).collect():
        assert got[r.g].different == direct[r.g].different == twice[r.g].different and abs(got[r.g].different - r.n) <= sketches.ERROR * r.n
        assert (got[r.g].rows, twice[r.g].rows) == (r.rows, 2 * r.rows)
    few = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("b", None)], "g string, v long")
    assert sorted(map(tuple, sketches.estimated(sketches.sketched(few, ["g"], "v"), ["g"]).collect())) == [("a", 3, 1), ("b", 1, 0)]
