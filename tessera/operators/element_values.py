"""Values of element rows by type: strict getters, which are null where an element holds another kind, and the traits of its VR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.plans import dims

TEXT_VRS = [vr for vr, _, text, *_ in dims.VR if text]
BYTE_VRS = ["OB", "OW", "UN"]


def _of(vrs: list[str], value: Column) -> Column:
    return F.when(F.col("vr").isin(vrs), value)


def as_strings() -> Column:
    """All values of a text element; null where it is none or empty."""
    return _of(TEXT_VRS, F.col("s"))


def as_string() -> Column:
    """The first value of a text element; of a person name its alphabetic part."""
    first = F.get("s", F.lit(0))
    return _of(TEXT_VRS, F.when(F.col("vr") == "PN", F.substring_index(first, "=", 1)).otherwise(first))


def as_u16() -> Column:
    """The first value of a US element."""
    return _of(["US"], F.get("i", F.lit(0)).cast("int"))


def as_u32() -> Column:
    """The first value of a UL or OL element, as a long: it may exceed 31 bits."""
    return _of(["UL", "OL"], F.get("i", F.lit(0)).cast("long"))


def as_i32() -> Column:
    """The first value of an SL element."""
    return _of(["SL"], F.get("i", F.lit(0)).cast("int"))


def as_f64() -> Column:
    """The first value of an FD or OD element, or of a decimal string that is a number."""
    return _of(["FD", "OD"], F.get("f", F.lit(0))).when(F.col("vr") == "DS", F.expr("try_cast(trim(get(s, 0)) AS DOUBLE)"))


def as_bytes() -> Column:
    """The bytes of an OB, OW or UN element, pixel data among them; text and numbers have none."""
    return _of(BYTE_VRS, F.col("b"))


def typed(elements: DataFrame) -> DataFrame:
    """Element rows with each getter's value beside them: string, strings, u16, u32, i32, f64, bytes. Empty elements have none; error rows neither."""
    getters = {"string": as_string(), "strings": as_strings(), "u16": as_u16(), "u32": as_u32(), "i32": as_i32(), "f64": as_f64(), "bytes": as_bytes()}
    return elements.withColumns(getters)


def with_vr_traits(elements: DataFrame) -> DataFrame:
    """Element rows with name, is_text, long_length, padding and fixed_size of their VR: a constant table of 34 rows is broadcast. An unknown VR
    has nulls there, and rows stay."""
    return elements.join(F.broadcast(dims.dim_vr(elements.sparkSession)), "vr", "left")


def items_of(elements: DataFrame, path: str) -> DataFrame:
    """The elements of the items of one sequence as data sets of their own: `file`, `item` (from 0), and the row's columns with `path` and `depth` from the item on.

    A sequence without items, or a path that is none in a file, gives no rows for it; empty items have no elements.
    """
    own = path.strip("/").upper()
    below = elements.where(F.col("path").startswith(own + "/") & (F.col("path").rlike(f"^{own}/[0-9]+/")))
    rest = F.substring("path", len(own) + 2, 1 << 20)
    item, inner = F.substring_index(rest, "/", 1), F.expr(f"substring(path, {len(own) + 3} + length(substring_index(substring(path, {len(own) + 2}), '/', 1)))")
    depth = own.count("/") // 2 + 1
    return below.select("file", item.cast("int").alias("item"), inner.alias("path"), (F.col("depth") - depth).alias("depth"), "tag", "vr", "s", "i", "f", "b", "error")
