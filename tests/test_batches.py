"""Rows of many files in one batch, values that their VR can't hold, PDUs of few long values."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from tessera import queries
from tessera.functions import pdu
from tessera.sources import part10


def test_element_rows_of_many_files_share_a_batch():
    content = part10.encoded(0x00100020, "LO", b"7", explicit=False)
    files = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(9000)]), pa.array([content] * 4500 + [b"\x10\x00"] + [content] * 4499, pa.binary())], names=["file", "content"])
    out = list(part10._parsed(None)(iter([files])))
    assert len(out) == 2 and sum(b.num_rows for b in out) == 9000
    assert [r for b in out for r in b.column(0).to_pylist()] == [str(k) for k in range(9000)]
    assert sum(b.column(9).null_count for b in out) == 8999
    large = [pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([part10.encoded(0x7FE00010, "OW", bytes(5 << 20), explicit=False)])], names=["file", "content"]) for _ in range(5)]
    assert [b.num_rows for b in part10._parsed(None)(iter(large))] == [2, 2, 1]


def test_elements_whose_vr_cannot_hold_a_value_are_empty(spark, tmp_path):
    customer = spark.createDataFrame([(k, f"C#{k}", 1, 2.5, "AUTO") for k in (1, 30_677, 30_678, 2**32)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    customer.write.parquet(str(tmp_path / "customer.parquet"))
    rows = queries.element_getters(spark, str(tmp_path)).collect()
    assert len(rows) == 44
    assert {r.file: r.i32 for r in rows if r.vr == "SL"} == {"1": -70000, "30677": -30_677 * 70_000, "30678": -30_678 * 70_000 if 30_678 * 70_000 <= 2**31 else None, str(2**32): None}
    assert {r.file: r.u32 for r in rows if r.vr == "UL"} == {"1": 2**32 - 2, "30677": 2**32 - 1 - 30_677, "30678": 2**32 - 1 - 30_678, str(2**32): None}
    assert queries.vr_traits(spark, str(tmp_path)).count() == 44


def test_walks_are_whole_and_stop_at_what_does_not_fit(spark):
    sizes = [[0], [1], [0] * 40, [3, 0, 5] * 30, [100_000, 1, 0], [70_000] * 3, []]
    part = F.transform("sizes", lambda n, k: F.struct((k % 3).cast("int").alias("context"), F.lit(2).alias("control"), F.expr("encode(repeat('x', 1), 'UTF-8')").alias("data"), n.alias("n")))
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "id int, sizes array<int>")
    filled = F.transform(part, lambda p: F.struct(p["context"].alias("context"), p["control"].alias("control"), F.encode(F.repeat(F.lit("x"), p["n"]), "UTF-8").alias("data")))
    out = df.withColumn("body", pdu.body(pdu.p_data(filled))).select("id", pdu.pdvs(F.col("body")).alias("all"), pdu.pdvs(F.concat("body", F.lit(b"\0\0\0\x09ab"))).alias("cut"), pdu.pdvs(F.lit(None).cast("binary")).alias("none"))
    for r in out.collect():
        assert [len(p.data) for p in r["all"]] == sizes[r.id] and [p.context for p in r["all"]] == [k % 3 for k in range(len(sizes[r.id]))]
        assert [len(p.data) for p in r["cut"]] == sizes[r.id] and r["none"] == []


def test_walks_of_long_texts_do_not_grow_with_their_square(spark):
    body = lambda n: F.concat(*[F.concat(pdu.big_endian(F.lit(n + 2), 4), F.lit(b"\3\2"), F.encode(F.repeat(F.lit("x"), n), "UTF-8"))])
    took = []
    for n in (1_000, 1_500_000):
        began = time.perf_counter()
        assert spark.range(2).select(F.size(pdu.pdvs(F.concat(body(n), F.col("id").cast("string").cast("binary")))).alias("n")).agg(F.sum("n")).head()[0] == 2
        took.append(time.perf_counter() - began)
    assert took[1] < took[0] + 20
