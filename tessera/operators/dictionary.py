"""Tag lookups: exact entries by an equi-join with a constant table, repeating entries and other ranges by conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.operators.intervals import first_range_of
from tessera.plans.dims import TAG_RANGE, dim_tag, dim_uid

#: Most ranges of a dimension that become conditions, each within the next: hundreds are too deep for the planner's stack.
MOST_RANGES = 64


def with_entry(df: DataFrame, tag: str) -> DataFrame:
    """Adds vr and keyword of each tag (group * 65536 + element): the exact entry, else the first repeating one, else UN.

    A null tag is UN without a keyword. Every row stays, repeated ones too; columns named vr and keyword are replaced.
    """
    exact = dim_tag(df.sparkSession).select(F.col("tag").alias("__tag"), F.col("vr").alias("__vr"), F.col("keyword").alias("__keyword"))
    out = df.join(F.broadcast(exact), F.col(tag) == F.col("__tag"), "left")  # a constant table
    group, element = F.floor(F.col(tag) / 65536), F.col(tag) % 65536
    vr = keyword = F.lit(None).cast("string")
    for group_low, group_high, element_low, element_high, parity, own_vr, own_keyword in reversed(TAG_RANGE):
        fits = group.between(group_low, group_high) & element.between(element_low, element_high) & {"any": F.lit(True), "even": group % 2 == 0, "odd": group % 2 == 1}[parity]
        vr, keyword = F.when(fits, own_vr).otherwise(vr), F.when(fits, own_keyword).otherwise(keyword)
    kept = [c for c in df.columns if c not in ("vr", "keyword")]
    return out.select(*kept, F.coalesce("__vr", vr, F.lit("UN")).alias("vr"), F.coalesce("__keyword", keyword).alias("keyword"))


def range_lookup(df: DataFrame, value: str, ranges: DataFrame, low: str, high: str, order: str) -> DataFrame:
    """Each row with the columns of the first range (by `order`) that holds its value, null where none does or the value is null.

    At most MOST_RANGES ranges become conditions of the row itself, so that no row moves; more are joined by equal blocks, which takes
    whole numbers. Repeated rows stay, ranges with a null bound hold nothing, and a column of `df` named like one of the ranges' is replaced.
    """
    rows = ranges.orderBy(order).limit(MOST_RANGES + 1).collect()
    if len(rows) > MOST_RANGES:
        return first_range_of(df, value, ranges, low, high, order)
    names = [c for c in ranges.columns if c not in (low, high)]
    kind = ranges.select(*names).schema
    found = F.lit(None).cast(kind)
    for r in reversed(rows):
        own = F.struct(*[F.lit(r[n]).cast(kind[n].dataType).alias(n) for n in names])
        found = F.when(F.col(value).between(F.lit(r[low]), F.lit(r[high])), own).otherwise(found)
    own = df.withColumn("__found", found)
    return own.select(*[c for c in df.columns if c not in names], *[F.col(f"__found.{n}").alias(n) for n in names])


def with_uid_name(df: DataFrame, uid: str) -> DataFrame:
    """Adds `uid_name`, null for a UID that the table doesn't have. Trailing blanks and zero bytes of a UID don't count."""
    names = dim_uid(df.sparkSession).select(F.col("uid").alias("__uid"), F.col("name").alias("uid_name"))
    own = F.regexp_replace(F.col(uid), "[ \\x00]+$", "")
    return df.drop("uid_name").join(F.broadcast(names), own == F.col("__uid"), "left").drop("__uid")  # a constant table


def with_private_entry(elements: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds private_vr and private_keyword of private elements, by the creator that reserved their block in the same data set and level.

    A block of an odd group is reserved by the element (group, 00xx) whose value names the creator; its elements are (group, xxyy). entries:
    creator, group, element (yy), vr, keyword, each creator, group and element once. Null where the block has no creator or the
    creator no entry. A creator that is named twice counts as the one that comes first by its name.
    """
    odd, low = F.floor(F.col("tag") / 65536) % 2 == 1, F.col("tag") % 65536
    level = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    creators = elements.where(odd & low.between(0x10, 0xFF)).groupBy("file", level.alias("__level"), (F.floor(F.col("tag") / 65536) * 256 + low).alias("__block")).agg(F.min(F.trim(F.get("s", F.lit(0)))).alias("__creator"))
    block = F.when(odd & (low >= 0x1000), F.floor(F.col("tag") / 65536) * 256 + F.floor(low / 256))
    own = elements.withColumns({"__level": level, "__block": block, "__group": F.floor(F.col("tag") / 65536), "__element": low % 256})
    own = own.join(creators, ["file", "__level", "__block"], "left")
    known = entries.select(F.col("creator").alias("__creator"), F.col("group").cast("long").alias("__group"), F.col("element").cast("long").alias("__element"), F.col("vr").alias("private_vr"), F.col("keyword").alias("private_keyword"))
    return own.join(known, ["__creator", "__group", "__element"], "left").select(*elements.columns, "private_vr", "private_keyword")
