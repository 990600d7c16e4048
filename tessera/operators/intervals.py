"""Interval joins by equality: ranges cut into dyadic blocks, so that no plan compares rows with ranges one by one.

A block of level k holds the 2^k whole numbers whose first bits agree. Every range of whole numbers is the union of a few blocks, two of each level
at most, and a value lies in exactly one block of each level; so value and range meet by (level, block) and need no further condition. Of
the ranges that hold the same block only the first counts, which leaves one row for each block however many ranges overlap there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from tessera.sources.files import shared_folder

#: Rows of a looked-up table that may be broadcast; rows of one key that a join may leave together, and at most so many parts of a key that has more.
MOST_BROADCAST, MOST_OF_KEY, SALTS = 50_000, 100_000, 1024
#: Levels of blocks: whole numbers are longs.
LEVELS = 62


def looked_up(rows: DataFrame, lookup: DataFrame, key: str, n: str) -> DataFrame:
    """`rows` with the columns of `lookup`, which has each key once, with the number `n` of rows that have it; null where it has none. The lookup is
    counted: a small one is broadcast. With a larger one the rows of a key that has many are dealt to several places, so that none is one task's;
    only such keys are repeated there, and they are few."""
    if lookup.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(lookup.drop(n)), key, "left")
    parts = F.least(F.lit(SALTS), F.ceil(F.col(n) / MOST_OF_KEY)).cast("int")
    frequent = lookup.where(F.col(n) > MOST_OF_KEY).select(key, parts.alias("__parts"))
    own = rows.join(F.broadcast(frequent), key, "left")
    own = own.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    salted = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop(n)
    return own.join(salted, [key, "__salt"], "left").drop("__salt")


def _kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder, so that what is used twice is made once."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/intervals-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def blocks_of(low: Column, high: Column) -> Column:
    """The blocks of a range, both ends included, as an array of (level, block).

    From the smallest level up, an odd lower end gives its block and moves one up, an even upper end gives its block and moves one down; then both
    ends go to the next level, until they have passed each other.
    """
    start = F.struct(F.array().cast("array<struct<level:int,block:bigint>>").alias("found"), low.cast("long").alias("l"), high.cast("long").alias("h"))

    def up(s: Column, k: Column) -> Column:
        none = F.array().cast("array<struct<level:int,block:bigint>>")
        open_ = s["l"] <= s["h"]
        odd, even = open_ & (F.pmod(s["l"], F.lit(2)) == 1), open_ & (F.pmod(s["h"], F.lit(2)) == 0)
        # one block may be both ends: it is given once
        own = F.when(odd, F.array(F.struct(k.alias("level"), s["l"].alias("block")))).otherwise(none)
        last = F.when(even & ~(odd & (s["l"] == s["h"])), F.array(F.struct(k.alias("level"), s["h"].alias("block")))).otherwise(none)
        low_up, high_up = F.when(odd, s["l"] + 1).otherwise(s["l"]), F.when(even, s["h"] - 1).otherwise(s["h"])
        more = low_up <= high_up  # ends that have passed each other stay so
        return F.struct(F.concat(s["found"], own, last).alias("found"), F.when(more, F.shiftright(low_up, 1)).otherwise(F.lit(1)).cast("long").alias("l"), F.when(more, F.shiftright(high_up, 1)).otherwise(F.lit(0)).cast("long").alias("h"))

    # a range of n numbers has no block above level log2(n); a length that overflows, or a null, takes all levels
    n = F.try_subtract(high.cast("long"), low.cast("long"))
    most = F.when(n < 0, 0).otherwise(F.least(F.lit(LEVELS), F.ceil(F.log2(n.cast("double") + 1)) + 1))
    return F.aggregate(F.sequence(F.lit(0), F.coalesce(most.cast("int"), F.lit(LEVELS))), start, up)["found"]


def first_ranges(values: DataFrame, ranges: DataFrame, low: str, high: str, order: str) -> DataFrame:
    """(value, order): for each value (a column of distinct longs; other columns stay) the order of the first range that holds it. Values that no
    range holds are left out."""
    own = ranges.where(F.col(low).isNotNull() & F.col(high).isNotNull() & (F.col(low) <= F.col(high)))
    blocks = own.select(F.col(order).alias("__order"), F.explode(blocks_of(F.col(low), F.col(high))).alias("at"))
    blocks = blocks.groupBy(F.col("at.level").alias("level"), F.col("at.block").alias("block")).agg(F.min("__order").alias("__order"))
    blocks = _kept(blocks)  # looked at for its levels, then joined
    levels = sorted(r[0] for r in blocks.select("level").distinct().collect())  # at most LEVELS + 1
    if not levels:
        return values.withColumn("__order", F.lit(None).cast(blocks.schema["__order"].dataType)).limit(0)
    others = [c for c in values.columns if c != "value"]
    keyed = values.select("value", *others, F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("value", k).alias("block")) for k in levels])).alias("at"))
    keyed = keyed.select("value", *others, F.col("at.level").alias("level"), F.col("at.block").alias("block"))
    return keyed.join(blocks, ["level", "block"]).groupBy("value", *others).agg(F.min("__order").alias("__order"))


def first_range_of(df: DataFrame, value: str, ranges: DataFrame, low: str, high: str, order: str) -> DataFrame:
    """Each row with the columns of the first range (by `order`) that holds its value, both ends included; null where none does.

    Values and ends are whole numbers (dates as days, times as microseconds); `order` has each value once, and any number of ranges may be given, and overlap.
    Every row stays, repeated ones too; null values, ranges with a null end and empty ranges (high below low) meet nothing. A column of `df` named like one of the
    ranges' is replaced. Each different value is looked up once, so a value that many rows have is no one's burden; all joins are by equality.
    Blocks carry the order alone, by which the ranges found give their other columns at the end.
    """
    names = [c for c in ranges.columns if c not in (low, high)]
    distinct = df.select(F.col(value).cast("long").alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("__n"))
    found = _kept(first_ranges(distinct, ranges, low, high, order))  # joined with the ranges, then with the rows
    given = ranges.where(F.col(low).isNotNull() & F.col(high).isNotNull() & (F.col(low) <= F.col(high))).select(F.col(order).alias("__order"), F.struct(*names).alias("__found"))
    if [c for c in names if c != order]:
        # what is found is dealt by its value again: a range may be the first of very many values
        found = _joined(found, given)
    else:
        found = found.select("value", "__n", F.struct(F.col("__order").alias(order)).alias("__found"))
    found = found.withColumnRenamed("value", "__value")
    own = looked_up(df.withColumn("__value", F.col(value).cast("long")), _kept(found), "__value", "__n")  # counted, then joined
    return own.select(*[c for c in df.columns if c not in names], *[F.col(f"__found.{n}").alias(n) for n in names])


def _joined(found: DataFrame, given: DataFrame) -> DataFrame:
    """(value, n, found) of (value, n, order) and the ranges by order, as `looked_up` has it."""
    counts = found.groupBy("__order").agg(F.count("*").alias("__times"))
    return looked_up(found, _kept(given.join(counts, "__order")), "__order", "__times").select("value", "__n", "__found")
