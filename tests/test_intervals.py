import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.operators import dictionary, intervals


def blocks(spark, ends):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(ends)], "k int, low long, high long")
    return {r.k: [(x.level, x.block) for x in r.b] for r in df.select("k", intervals.blocks_of(F.col("low"), F.col("high")).alias("b")).collect()}


def test_blocks_tile_the_range(spark):
    rng = random.Random(1)
    ends = [(0, 0), (0, 7), (1, 6), (-5, 3), (-8, -8), (7, 6), (5, 5), (1, 1)] + [(a, a + rng.randrange(300)) for a in (rng.randrange(-500, 500) for _ in range(200))]
    for k, own in blocks(spark, ends).items():
        held = [v for level, block in own for v in range(block << level, (block + 1) << level)]
        assert sorted(held) == list(range(ends[k][0], ends[k][1] + 1)), ends[k]
        assert max((sum(level == x for level, _ in own) for x in range(62)), default=0) <= 2
    big = blocks(spark, [(-(2**62), 2**62 - 1), (-(2**40) + 1, 2**50)])
    assert all(sum(1 << level for level, _ in own) == n for own, n in zip(big.values(), (2**63, 2**50 + 2**40)))


def brute(values, ranges):
    return [next((name for _, name, a, b in sorted(ranges, key=lambda r: r[0]) if v is not None and a is not None and b is not None and a <= v <= b), None) for v in values]


def looked(spark, values, ranges):
    df = spark.createDataFrame(list(enumerate(values)), "id int, v long").withColumn("name", F.lit("replaced"))
    table = spark.createDataFrame(ranges, "o long, name string, low long, high long")
    out = intervals.first_range_of(df, "v", table, "low", "high", "o")
    assert out.columns == ["id", "v", "o", "name"]
    return [r.name for r in sorted(out.collect(), key=lambda r: r.id)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_brute_force(spark, broadcast, monkeypatch):
    monkeypatch.setattr(intervals, "MOST_BROADCAST", 50_000 if broadcast else 0)
    rng = random.Random(7)
    ranges = [(k, f"r{k}", a, a + rng.choice([0, 1, 9, 500, -1])) for k, a in enumerate(rng.randrange(-1000, 1000) for _ in range(150))]
    ranges += [(1000, "null end", None, 5), (1001, "no end", 5, None), (-1, "all of it", 400, 5000)]
    rng.shuffle(ranges)
    values = [rng.randrange(-1100, 1700) for _ in range(400)] + [None, 7, 7] + [42] * 300
    assert looked(spark, values, ranges) == brute(values, ranges)
    assert looked(spark, values[:5], []) == [None] * 5 and looked(spark, [], ranges) == []


def test_many_ranges_make_no_nested_loop(spark):
    """100,000 overlapping ranges: joins by equality alone, right at every value looked at."""
    n = 100_000
    table = spark.range(n).select(F.col("id").alias("o"), F.concat(F.lit("r"), "id").alias("name"), (F.pmod(F.xxhash64("id"), F.lit(10_000_000))).alias("low"))
    table = table.withColumn("high", F.col("low") + F.pmod(F.xxhash64("low"), F.lit(5000)))
    points = spark.range(3000).select("id", F.pmod(F.xxhash64(F.col("id") + 7), F.lit(10_100_000)).alias("v"))
    out = intervals.first_range_of(points, "v", table, "low", "high", "o")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r.id: r.o for r in out.select("id", "o").collect()}
    ranges = [tuple(r) for r in table.select("o", "low", "high").collect()]
    for r in points.limit(200).collect():
        assert got[r.id] == min((o for o, a, b in ranges if a <= r.v <= b), default=None)


def test_the_dictionary_takes_any_number_of_ranges(spark):
    df = spark.createDataFrame([(k,) for k in range(0, 5000, 7)], "v long")
    few = spark.createDataFrame([(k, f"b{k}", 10 * k, 10 * k + 4) for k in range(400)], "o long, name string, low long, high long")
    many = few.union(spark.createDataFrame([(1000 + k, f"w{k}", 3 * k, 3 * k) for k in range(1500)], few.schema))
    for ranges in (few, many):
        own = {r.v: r.name for r in dictionary.range_lookup(df, "v", ranges, "low", "high", "o").collect()}
        rows = [tuple(r) for r in ranges.collect()]
        assert own == dict(zip(own, brute(list(own), rows)))


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-5, 60)), max_size=12))
def test_first_range_of_any_ranges(spark, ends):
    ranges = [(k, str(k), a, a + n) for k, (a, n) in enumerate(ends)]
    values = list(range(-60, 120, 3))
    assert looked(spark, values, ranges) == brute(values, ranges)


def test_only_frequent_keys_of_a_large_lookup_are_repeated(spark, monkeypatch):
    monkeypatch.setattr(intervals, "MOST_BROADCAST", 10)
    monkeypatch.setattr(intervals, "MOST_OF_KEY", 20)
    points = spark.range(300).select("id", F.when(F.col("id") < 100, 7).otherwise(F.col("id")).alias("v"))
    table = spark.range(40).select(F.col("id").alias("o"), (F.col("id") * 5).alias("low"), (F.col("id") * 5 + 2).alias("high"), F.concat(F.lit("r"), "id").alias("name"))
    out = intervals.first_range_of(points, "v", table, "low", "high", "o")
    want = {k: (lambda v: f"r{v // 5}" if v < 200 and v % 5 < 3 else None)(7 if k < 100 else k) for k in range(300)}
    assert out.count() == 300 and {r.id: r.name for r in out.collect()} == want
    counts = spark.createDataFrame([(k, f"n{k}", 100 if k == 7 else 1) for k in range(30)], "v long, t string, n long")
    plan = intervals.looked_up(points.withColumn("v", F.col("v").cast("long")), counts, "v", "n")
    assert plan.count() == 300 and {r.t for r in plan.where("id < 100").collect()} == {"n7"}
