import random
import zlib

from tessera.llm.sharding import shard


def check(spark, rows, shards=24, **how):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, shard string, slot int").repartition(5)
    out = shard(df, shards=shards, **how).toPandas()
    assert sorted(zip(out.doc_id.fillna(-1), out["size"], out.text_crc32)) == sorted(((-1 if d is None else d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    return out


def test_bytes_are_near_equal(spark):
    rng = random.Random(3)
    rows = [(k, "é" * rng.randrange(0, 400)) for k in range(4000)]
    for pieces in (1, 5):
        out = check(spark, rows, piece_bytes=max(1, 1_600_000 // 24 // pieces))
        by = out.groupby("shard")["size"].sum()
        assert len(by) == 24 and by.max() - by.min() <= 0.004 * by.mean() + 2 * 808


def test_order_is_that_of_exact_cuts(spark):
    """With no tolerance, a row's shard is that of the bytes before it in the order of the keys."""
    from pyspark.sql import functions as F

    from tessera.llm.sharding import _key

    rows = [(k, f"text {k % 700} " * (k % 13)) for k in range(3000)]
    out = check(spark, rows, tolerance=0.0)
    keys = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", _key(F.col("text")).alias("k1"), _key(F.lit("id"), F.col("doc_id")).alias("k2")).toPandas()
    own = out.merge(keys, on="doc_id").sort_values(["k1", "k2"])
    before, total = own["size"].cumsum() - own["size"], own["size"].sum()
    ideal = before * 24 / total
    assert (abs(own["shard"] - ideal.astype(int)) <= 1).all()
    assert own["shard"].is_monotonic_increasing
    by = own.groupby("shard")["size"].sum()
    assert by.max() - by.min() <= 2 * own["size"].max()


def test_hot_group_and_repeated_rows(spark):
    rows = [(k, "the hot text") for k in range(3000)] + [(5, "same row")] * 2500 + [(100_000 + k, f"own {k}") for k in range(2000)]
    out = check(spark, rows)
    by = out.groupby("shard")["size"].sum()
    assert by.max() - by.min() <= 0.01 * by.mean() + 40


def test_equal_texts_stay_together(spark):
    rows = [(k, f"text of group {k % 500} " * 3) for k in range(2000)]
    out = check(spark, rows, tolerance=0.05)
    own = out.groupby("text_crc32")["shard"].nunique()
    assert (own > 1).sum() <= 23


def test_edges(spark):
    assert len(check(spark, [(1, None)])) == 1
    assert len(check(spark, [(1, ""), (None, None), (None, ""), (2, "x" * 300_000)])) == 4
    assert shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
