"""DICOM JSON and the Native DICOM Model XML as Column expressions over element rows.

Sequences are rendered from the innermost items outwards, one grouping for each level of nesting that occurs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.values import person_component, person_groups, xml_escape
from tessera.sources.files import shared_folder

BULK = ["OB", "OD", "OF", "OL", "OV", "OW", "UN"]
JSON_ELEMENTS = "map<string, struct<vr: string, Value: array<string>, InlineBinary: string, BulkDataURI: string>>"


def _quoted(c: Column) -> Column:
    """A JSON string: the array form of to_json without its brackets."""
    text = F.to_json(F.array(c))
    return F.substring(text, F.lit(2), F.length(text) - 2)


ITEM = 0xFFFEE000


def parent(path: Column) -> Column:
    """The path without its last part; empty for the top level."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def nested(elements: DataFrame, element: Column, whole: Callable[[Column], Column], items: Callable[[Column], Column], file: str = "file") -> DataFrame:
    """(file, text) of the data set of each file, in tag order, without group lengths.

    element: the text of a row, from `items` (that of its items, null where it has none) among others. whole: the text of a data set or item
    from the array of its elements' texts. items: the text of a sequence from the array of its items' texts. Encapsulated pixel data are one
    element without a value. Rows with an error are left out; an element that is there twice is shown twice.
    """
    fragment = F.col("path").rlike("7FE00010/[0-9]+$")
    rows = elements.where("error IS NULL").where((F.col("tag") % 65536 != 0) | (F.col("tag") == ITEM)).where(~fragment | F.col("path").endswith("/0"))
    rows = rows.withColumns({"b": F.when(~fragment, F.col("b")), "path": F.when(fragment, parent(F.col("path"))).otherwise(F.col("path"))}).drop("items")
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    inner = None
    for depth in range(deepest, -1, -1):
        own = rows.where(F.col("depth") == depth)
        own = own.withColumn("items", F.lit(None).cast("string")) if inner is None else own.join(inner, [file, "path"], "left")
        parts = F.array_sort(F.collect_list(F.struct("tag", element.alias("text"))))
        texts = own.where(F.col("tag") != ITEM).groupBy(F.col(file), parent(F.col("path")).alias("at")).agg(whole(F.transform(parts, lambda p: p["text"])).alias("text"))
        if depth == 0:
            return texts.select(file, "text")
        marked = own.where(F.col("tag") == ITEM).select(file, F.col("path").alias("at"))
        each = marked.join(texts, [file, "at"], "full").withColumn("text", F.coalesce("text", whole(F.array().cast("array<string>"))))
        number = F.regexp_extract("at", "([0-9]+)$", 1).cast("int")
        parts = F.array_sort(F.collect_list(F.struct(number.alias("n"), "text")))
        inner = each.groupBy(F.col(file), parent(F.col("at")).alias("path")).agg(items(F.transform(parts, lambda p: p["text"])).alias("items"))
    raise AssertionError


def _name_json(v: Column) -> Column:
    groups = person_groups(v)
    part = lambda key, c: F.when(c != "", F.concat(F.lit(f'"{key}":'), _quoted(c)))
    return F.concat(F.lit("{"), F.concat_ws(",", part("Alphabetic", groups["alphabetic"]), part("Ideographic", groups["ideographic"]), part("Phonetic", groups["phonetic"])), F.lit("}"))


def element_json(bulk_uri: Column | None = None) -> Column:
    """`"TTTTTTTT":{"vr":..,...}` of a row with tag, vr, s, i, f, b, items; bulk data as an URI where `bulk_uri` gives one, else inline."""
    text = F.transform("s", lambda v: F.when(F.col("vr") == "PN", _name_json(v)).when(F.col("vr").isin("DS", "IS"), F.trim(v)).otherwise(_quoted(v)))
    numbers = F.coalesce(F.transform("i", lambda v: v.cast("string")), F.transform("f", lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), "null").otherwise(v.cast("string"))))
    value = F.when(F.col("vr") == "SQ", F.col("items")).when(F.col("s").isNotNull(), F.array_join(text, ",")).when(numbers.isNotNull(), F.array_join(numbers, ","))
    inline = F.concat(F.lit(',"InlineBinary":"'), F.base64("b"), F.lit('"'))
    bulk = F.when(F.col("vr").isin(BULK) & bulk_uri.isNotNull(), F.concat(F.lit(',"BulkDataURI":'), _quoted(bulk_uri))) if bulk_uri is not None else F.lit(None).cast("string")
    rest = F.coalesce(bulk, F.when(F.col("b").isNotNull(), inline), F.when(value.isNotNull(), F.concat(F.lit(',"Value":['), value, F.lit("]"))), F.lit(""))
    return F.concat(F.lit('"'), F.lpad(F.hex("tag"), 8, "0"), F.lit('":{"vr":"'), F.col("vr"), F.lit('"'), rest, F.lit("}"))


def to_json(elements: DataFrame, file: str = "file", bulk_uri: Column | None = None) -> DataFrame:
    """(file, json): the object of each file; a sequence's Value holds an object for each item."""
    whole = lambda parts: F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
    return nested(elements, element_json(bulk_uri), whole, lambda parts: F.array_join(parts, ","), file).withColumnRenamed("text", "json")


def from_json(df: DataFrame, file: str = "file", json: str = "json") -> DataFrame:
    """(file, path, depth, tag, vr, value, inline, uri): a row for each element and item of DICOM JSON objects, nested ones too.

    Values are given as text as they stand, person names as `alphabetic=ideographic=phonetic`; `json_elements.read_json` has their types and says what is
    wrong with them. Text that is no object, and null, give no row; of a tag that an object has twice the last counts; repeated files give
    repeated rows. The items of each level of nesting are written to the shared folder, so each is parsed for itself, however many levels there are.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/json-{uuid.uuid4().hex}"
    level, depth, out = df.select(F.col(file).alias("file"), F.lit("").alias("at"), F.col(json).alias("object")), 0, None
    none = F.lit(None)
    name = lambda v: F.rtrim(F.concat_ws("=", *[F.coalesce(F.get_json_object(v, f"$.{g}"), F.lit("")) for g in ("Alphabetic", "Ideographic", "Phonetic")]), F.lit("="))
    while True:
        parsed = level.select("file", "at", F.explode(F.from_json("object", JSON_ELEMENTS)).alias("k", "e")).withColumn("path", F.concat("at", F.upper("k")))
        value = F.when(F.col("e.vr") == "PN", F.transform("e.Value", name)).when(F.col("e.vr") != "SQ", F.col("e.Value"))
        rows = parsed.select("file", "path", F.lit(depth).alias("depth"), F.conv("k", 16, 10).cast("long").alias("tag"), F.col("e.vr").alias("vr"), value.alias("value"), F.unbase64("e.InlineBinary").alias("inline"), F.col("e.BulkDataURI").alias("uri"))
        out = rows if out is None else out.unionByName(rows)
        items = parsed.where("e.vr = 'SQ'").select("file", "path", F.posexplode("e.Value").alias("n", "object"))
        items.select("file", F.concat("path", F.lit("/"), F.col("n").cast("string")).alias("path"), "object").write.parquet(f"{folder}/{depth}")
        items = spark.read.parquet(f"{folder}/{depth}")
        if items.isEmpty():
            return out.withColumnRenamed("file", file)
        depth += 1
        out = out.unionByName(items.select("file", "path", F.lit(depth).alias("depth"), F.lit(ITEM).cast("long").alias("tag"), F.lit("").alias("vr"), none.cast("array<string>").alias("value"), none.cast("binary").alias("inline"), none.cast("string").alias("uri")))
        level = items.select("file", F.concat("path", F.lit("/")).alias("at"), "object")


def element_xml() -> Column:
    """A DicomAttribute element of a row with tag, vr, s, i, f, b, items; an empty one is closed in itself."""
    head = F.concat(F.lit('<DicomAttribute tag="'), F.lpad(F.hex("tag"), 8, "0"), F.lit('" vr="'), F.col("vr"), F.lit('"'))
    plain = F.coalesce(F.transform("s", xml_escape), F.transform("i", lambda v: v.cast("string")), F.transform("f", lambda v: v.cast("string")))
    values = F.array_join(F.transform(plain, lambda v, k: F.concat(F.lit('<Value number="'), (k + 1).cast("string"), F.lit('">'), v, F.lit("</Value>"))), "")

    def name(v: Column, k: Column) -> Column:
        groups = person_groups(v)

        def group(key: str, own: Column) -> Column:
            # fixed names of the standard (PS3.19 table A.1.5-2), in the order of a name's components
            parts = [(n, person_component(own, at)) for at, n in enumerate(("FamilyName", "GivenName", "MiddleName", "NamePrefix", "NameSuffix"))]
            inner = F.concat(*[F.when(c != "", F.concat(F.lit(f"<{n}>"), xml_escape(c), F.lit(f"</{n}>"))).otherwise("") for n, c in parts])
            return F.when(own != "", F.concat(F.lit(f"<{key}>"), inner, F.lit(f"</{key}>"))).otherwise("")

        return F.concat(F.lit('<PersonName number="'), (k + 1).cast("string"), F.lit('">'), *[group(key, groups[key.lower()]) for key in ("Alphabetic", "Ideographic", "Phonetic")], F.lit("</PersonName>"))

    names = F.array_join(F.transform("s", name), "")
    binary = F.when(F.col("b").isNotNull(), F.concat(F.lit("<InlineBinary>"), F.base64("b"), F.lit("</InlineBinary>")))
    inner = F.when(F.col("vr") == "SQ", F.col("items")).when(F.col("vr") == "PN", names).otherwise(F.coalesce(binary, values))
    return F.when(inner.isNull(), F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">"), inner, F.lit("</DicomAttribute>")))


def to_xml(elements: DataFrame, file: str = "file") -> DataFrame:
    """(file, xml) of each file; the items of a sequence are numbered from 1."""
    tagged = lambda parts: F.array_join(F.transform(parts, lambda x, k: F.concat(F.lit('<Item number="'), (k + 1).cast("string"), F.lit('">'), x, F.lit("</Item>"))), "")
    out = nested(elements, element_xml(), lambda parts: F.array_join(parts, ""), tagged, file)
    return out.select(file, F.concat(F.lit("<NativeDicomModel>"), "text", F.lit("</NativeDicomModel>")).alias("xml"))


def dump(elements: DataFrame, line: Column, file: str = "file") -> DataFrame:
    """(file, dump): a line for each element, items of sequences indented between lines that count them. line: of a row with tag, vr, s, i, f, b."""
    indented = lambda text: F.regexp_replace(text, "(?m)^", "  ")
    items = lambda parts: F.array_join(F.transform(parts, lambda x, k: F.concat(F.lit("item "), (k + 1).cast("string"), F.when(x != "", F.concat(F.lit("\n"), indented(x))).otherwise(""))), "\n")
    own = F.when(F.col("items").isNotNull(), F.concat(line, F.lit("\n"), indented(F.col("items")))).otherwise(line)
    return nested(elements, own, lambda parts: F.array_join(parts, "\n"), items, file).withColumnRenamed("text", "dump")
