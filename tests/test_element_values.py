"""Getters by type, and sequences put in with their items."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.operators import datasets, element_values

ROW = "file string, path string, depth int, tag long, vr string, s array<string>, i array<decimal(20,0)>, f array<double>, b binary, error string"


def element(file, path, vr, s=None, i=None, f=None, b=None):
    tag = 0xFFFEE000 if vr == "" else int(path[-8:], 16)
    return (file, path, (path.count("/") + 1) // 2, tag, vr, s, i and [Decimal(v) for v in i], f, b, None)


@pytest.mark.parametrize("row,getter,value", [
    (("LO", ["a", "b"]), "strings", ["a", "b"]), (("LO", ["a", "b"]), "string", "a"), (("PN", ["A^B=C=D"]), "string", "A^B"), (("PN", ["=C"]), "string", ""), (("US", None, [65535]), "u16", 65535), (("US", None, [1]), "u32", None),
    (("UL", None, [2**32 - 1, 5]), "u32", 2**32 - 1), (("SL", None, [-(2**31)]), "i32", -(2**31)), (("SS", None, [-1]), "i32", None), (("DS", [" 2.50 "]), "f64", 2.5), (("DS", ["x"]), "f64", None), (("FD", None, None, [0.1]), "f64", 0.1),
    (("OB", None, None, None, b"\1\2"), "bytes", b"\1\2"), (("LO", None), "strings", None), (("LO", []), "string", None), (("US", None, []), "u16", None), (("SQ", None), "string", None), ((None, ["x"]), "string", None),
])
def test_getters(spark, row, getter, value):
    out = element_values.typed(spark.createDataFrame([element("f", "00080008", *row)], ROW)).first()
    assert (bytes(out[getter]) if isinstance(out[getter], bytearray) else out[getter]) == value
    assert sum(out[g] is not None for g in ("u16", "u32", "i32", "f64", "bytes")) <= 1


def test_unknown_vr_keeps_its_row(spark):
    own = spark.createDataFrame([element("f", "00080008", "ZZ"), element("f", "00080009", "UT"), element("f", "00080010", None)], ROW)
    out = {r.path: (r.name, r.long_length) for r in element_values.with_vr_traits(own).collect()}
    assert out == {"00080008": (None, None), "00080009": ("Unlimited Text", True), "00080010": (None, None)}


def test_items_take_the_place_of_those_before(spark):
    base = [element(f, p, v) for f in "ab" for p, v in (("00081115", "SQ"), ("00081115/0", ""), ("00081115/0/00080060", "CS"), ("00100020", "LO"))]
    inner = [element("a", "00080060", "CS", ["X"]), element("a", "00081140", "SQ"), element("a", "00081140/0", ""), element("a", "00081140/0/00081155", "UI", ["1.2"])]
    rows = [(*r, 7) for r in inner] + [(*element("a", "00080060", "CS", ["Y"]), 3), (*element("z", "00080060", "CS", ["Z"]), 0), (*element("a", "00080060", "CS", ["N"]), None), ("a", *[None] * 9, 12)]
    items = spark.createDataFrame(rows, ROW + ", item int").withColumn("extra", F.lit(1))
    out = datasets.with_items(spark.createDataFrame(base, ROW), "00081115", items).cache()
    paths = lambda f: sorted(r.path for r in out.where(F.col("file") == f).collect())
    assert paths("b") == ["00081115", "00100020"] and paths("z") == []
    assert paths("a") == ["00081115", "00081115/0", "00081115/0/00080060", "00081115/1", "00081115/1/00080060", "00081115/1/00081140", "00081115/1/00081140/0", "00081115/1/00081140/0/00081155", "00081115/2", "00100020"]
    assert {r.path: r.depth for r in out.where("file = 'a'").collect()} == {p: (p.count("/") + 1) // 2 for p in paths("a")}
    back = element_values.items_of(out, "00081115").select("item", "path", "depth", "s").collect()
    assert sorted((r.item, r.path, r.depth, r.s and r.s[0]) for r in back if r.s) == [(0, "00080060", 0, "Y"), (1, "00080060", 0, "X"), (1, "00081140/0/00081155", 1, "1.2")]
    assert element_values.items_of(out, "00081140").count() == 0
    with pytest.raises(ValueError):
        datasets.with_items(out, "00081115/0", items)
    out.unpersist()
