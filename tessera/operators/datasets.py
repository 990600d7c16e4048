"""Data sets as element rows: attribute paths, counting, editing, and pixel data cut into fragments.

An element's path names the way to it (00081115/0/00081155); the items of a sequence are rows of their own, with the path up to
their number. Editing gives new rows and leaves the old table as it is.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.frames import fragment_offsets

#: TAG or TAG/ITEM/TAG...: tags of eight hexadecimal digits, items of decimal ones.
PATH = r"^[0-9A-Fa-f]{8}(/[0-9]+/[0-9A-Fa-f]{8})*$"
PIXEL_DATA = "7FE00010"
_ITEM = 0xFFFEE000
_COLUMNS = ["path", "depth", "tag", "vr", "s", "i", "f", "b", "error"]


def normal_path(path: Column) -> Column:
    """The path without slashes at its ends, in upper case, items without leading zeros; null where it isn't one."""
    plain = F.upper(F.regexp_replace(path, "^/+|/+$", ""))
    parts = F.transform(F.split(plain, "/"), lambda x, k: F.when(k % 2 == 1, F.regexp_replace(x, "^0+(?=[0-9])", "")).otherwise(x))
    return F.when(plain.rlike(PATH), F.array_join(parts, "/"))


def resolve(elements: DataFrame, requests: DataFrame, file: str = "file", path: str = "path") -> DataFrame:
    """Each request (file, path) with `status`, the element's vr, s, i, f, b where it was found, and `n_items`.

    status: found; invalid (no path); no element; not a sequence (a tag within the path is none); out of range, where `n_items` says how many
    items the sequence has. Equal requests are each answered; a null file has no elements.
    """
    own = requests.select(F.col(file).alias("file"), F.col(path).alias("asked"), normal_path(F.col(path)).alias("path")).withColumn("id", F.monotonically_increasing_id())
    parts = F.split("path", "/")
    steps = own.where("path IS NOT NULL").select("id", "file", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("k", "path"))
    known = elements.select("file", "path", F.struct("vr", "s", "i", "f", "b").alias("e"))
    met = steps.join(known, ["file", "path"], "left")
    counts = elements.where(F.col("tag") == _ITEM).groupBy("file", F.regexp_extract("path", "^(.*)/[0-9]+$", 1).alias("path")).agg(F.count("*").alias("items"))
    met = met.join(counts, ["file", "path"], "left")
    step = F.sort_array(F.collect_list(F.struct("k", "e", "items")))
    met = met.groupBy("id").agg(step.alias("steps"))
    missing = F.get(F.filter("steps", lambda x: x["e"].isNull()), F.lit(0))
    last = F.element_at("steps", -1)["e"]
    before = F.get("steps", missing["k"] - 1)
    status = (
        F.when(F.col("path").isNull(), "invalid").when(missing.isNull(), "found").when(missing["k"] % 2 == 0, "no element")
        .when(before["e"]["vr"] != "SQ", "not a sequence").otherwise("out of range")
    )
    out = own.join(met, "id", "left").withColumn("status", status)
    value = F.when(F.col("status") == "found", last)
    items = F.when(F.col("status") == "found", F.element_at("steps", -1)["items"]).when(F.col("status") == "out of range", F.coalesce(before["items"], F.lit(0)))
    return out.select("file", F.col("asked").alias("path"), "status", *[value[c].alias(c) for c in ("vr", "s", "i", "f", "b")], items.alias("n_items"))


def summary(elements: DataFrame) -> DataFrame:
    """(file, n_elements, tags): the number of elements of each data set's top level, without the meta group, and their tags, ascending."""
    top = elements.where((F.col("depth") == 0) & ~F.col("path").contains("/") & (F.col("tag") >= 0x00030000))
    return top.groupBy("file").agg(F.count("*").alias("n_elements"), F.array_sort(F.collect_set("tag")).alias("tags"))


def removed(elements: DataFrame, path: str) -> DataFrame:
    """The rows without an element (or item) and all that it holds; items behind a removed one keep their numbers."""
    own = _known(path)
    return elements.where((F.col("path") != own) & ~F.col("path").startswith(own + "/"))


def _known(path: str) -> str:
    plain = path.strip("/").upper()
    if not re.fullmatch(PATH[1:-1] + r"(/[0-9]+)?", plain):
        raise ValueError(f"{path!r} is no attribute path")
    return plain


def with_value(elements: DataFrame, path: str, vr: str, *, s: Column | None = None, i: Column | None = None, f: Column | None = None, b: Column | None = None) -> DataFrame:
    """The rows with an element put in, or in the place of the one at `path`, in every data set.

    At most one of s (array of texts), i (array of whole numbers), f (array of doubles) and b (binary) gives the value, as a Column of
    constants and of `file`; none gives an empty element, or with vr SQ an empty sequence. An element inside items is put into
    the data sets that have the item.
    """
    own = _known(path)
    if sum(x is not None for x in (s, i, f, b)) > 1:
        raise ValueError("an element has one value")
    around = own.rpartition("/")[0]
    files = (elements.where(F.col("path") == around) if around else elements).select("file").distinct()
    made = {"path": F.lit(own), "depth": F.lit(own.count("/") // 2), "tag": F.lit(int(own[-8:], 16)).cast("long"), "vr": F.lit(vr), "s": s, "i": i, "f": f, "b": b, "error": None}
    kinds = {"s": "array<string>", "i": "array<decimal(20,0)>", "f": "array<double>", "b": "binary", "error": "string", "depth": "int"}
    rows = files.select("file", *[(made[c] if made[c] is not None else F.lit(None)).cast(kinds.get(c, "long" if c == "tag" else "string")).alias(c) for c in _COLUMNS])
    return removed(elements, own).select("file", *_COLUMNS).unionByName(rows)


def with_items(elements: DataFrame, path: str, items: DataFrame) -> DataFrame:
    """The rows with a sequence put in, or in the place of the one at `path`, in every data set, with the items that `items` gives to it.

    `items` holds element rows with `item`, a number that orders a sequence's items (gaps are closed, the first is 0); their paths and depths are
    those inside the item. A row with a null path stands for an item that is there without elements. Data sets that `items` does not name get an
    empty sequence; items of unknown data sets, and of null numbers, have no place and are left out. Rows that agree in file, item and path come twice.
    """
    own = _known(path)
    if not re.fullmatch(PATH[1:-1], own):
        raise ValueError(f"{path!r} is an item, not a sequence")
    out = with_value(elements, own, "SQ")
    inside = own.count("/") // 2 + 1
    places = out.where(F.col("path") == own).select("file").distinct()
    numbered = items.where(F.col("item").isNotNull()).select("file", "item").distinct()
    numbered = numbered.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("item")) - 1).join(places, "file", "left_semi")
    at = F.concat(F.lit(own + "/"), F.col("k").cast("string"))
    null = lambda kind: F.lit(None).cast(kind)
    heads = numbered.select("file", at.alias("path"), F.lit(inside).alias("depth"), F.lit(_ITEM).cast("long").alias("tag"), F.lit("").alias("vr"), null("array<string>").alias("s"),
                            null("array<decimal(20,0)>").alias("i"), null("array<double>").alias("f"), null("binary").alias("b"), null("string").alias("error"))
    held = items.where("path IS NOT NULL").join(numbered, ["file", "item"])
    held = held.select("file", F.concat(at, F.lit("/"), F.col("path")).alias("path"), (F.col("depth") + inside).cast("int").alias("depth"), "tag", "vr", "s", F.col("i").cast("array<decimal(20,0)>").alias("i"), "f", "b", "error")
    return out.unionByName(heads).unionByName(held)


def merged(elements: DataFrame, others: DataFrame) -> DataFrame:
    """The rows of both; where both have a path of a data set, that of `others` stays, with all below it."""
    top = others.select("file", F.substring("path", 1, 8).alias("__top")).distinct()
    own = elements.withColumn("__top", F.substring("path", 1, 8)).join(top, ["file", "__top"], "left_anti").drop("__top")
    return own.select("file", *_COLUMNS).unionByName(others.select("file", *_COLUMNS))


def encapsulated(fragments: DataFrame, file: str, frame: str, order: str, data: str) -> DataFrame:
    """Element rows of encapsulated pixel data of fragments: the offset table as 7FE00010/0, then the fragments in order.

    An offset is where the first fragment of a frame begins: 8 bytes and the even length of each fragment before it. All fragments of a file
    meet in one task only as keys and lengths, their bytes are dealt by fragment; a stream beyond the 32 bits of an offset is an error row.
    Fragments of equal order are ordered by a hash of their bytes.
    """
    own = fragments.select(F.col(file).cast("string").alias("file"), F.col(frame).alias("frame"), F.col(order).alias("order"), F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("b"))
    length = F.octet_length("b")
    at = fragment_offsets(own.select("file", "frame", "order", (length + length % 2).cast("long").alias("n")), ["file"], ["frame", "order"], F.col("n"))
    firsts = at.groupBy("file", "frame").agg(F.min("offset").alias("offset"))
    digits = lambda x: F.lpad(F.hex(x), 8, "0")
    swapped = lambda h: F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])
    table = F.transform(F.array_sort(F.collect_list("offset")), lambda x: swapped(digits(x)))
    offsets = firsts.groupBy("file").agg(F.unhex(F.array_join(table, "")).alias("b"), F.max("offset").alias("most"))
    error = F.when(F.col("most") > 0xFFFFFFFF, "the fragments are longer than an offset can say")
    # fragments are numbered by their keys alone, and the bytes then meet their number; equal fragments of one key share a range of numbers
    keys = ["file", "frame", "order", "h"]
    own = own.withColumn("h", F.xxhash64("b"))
    number = F.row_number().over(Window.partitionBy("file").orderBy("frame", "order", "h"))
    numbers = own.select(keys).withColumn("k", number).groupBy(keys).agg(F.min("k").alias("k"), F.count("*").alias("copies"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in keys]
    met = own.alias("x").join(numbers.alias("y"), reduce(and_, same)).select(*[F.col(f"x.{c}") for c in keys], "b", "k", "copies")
    again = F.row_number().over(Window.partitionBy("k", *keys).orderBy("k")) - 1
    met = met.where("copies = 1").unionByName(met.where("copies > 1").withColumn("k", F.col("k") + again))
    placed = met.select("file", "k", "b", F.lit(None).cast("string").alias("error"))
    both = placed.unionByName(offsets.select("file", F.lit(0).alias("k"), "b", error.alias("error")))
    none = F.lit(None)
    return both.select(
        "file", F.concat(F.lit(PIXEL_DATA + "/"), F.col("k").cast("string")).alias("path"), F.lit(0).alias("depth"), F.lit(int(PIXEL_DATA, 16)).cast("long").alias("tag"), F.lit("OB").alias("vr"),
        none.cast("array<string>").alias("s"), none.cast("array<decimal(20,0)>").alias("i"), none.cast("array<double>").alias("f"), "b", "error",
    )
