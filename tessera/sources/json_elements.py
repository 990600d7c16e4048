"""DICOM JSON as typed element rows: what an element's VR allows becomes values, all else an error row that says why.

Objects are parsed once into variants, which keep strings, numbers, nulls, arrays and objects apart. Each level of nesting is one pass over the items
that the level above wrote to the shared folder, so nothing is parsed twice and there is no greatest depth.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.values import parse_da, parse_dt, parse_tm
from tessera.plans.dims import VR
from tessera.sources.dicom_json import ITEM
from tessera.sources.files import shared_folder

#: Least and greatest value of the whole-number VRs, which their bytes fix.
WHOLE = {
    "IS": (-(2**63), 2**63 - 1), "US": (0, 2**16 - 1), "OW": (0, 2**16 - 1), "SS": (-(2**15), 2**15 - 1), "UL": (0, 2**32 - 1), "OL": (0, 2**32 - 1),
    "SL": (-(2**31), 2**31 - 1), "UV": (0, 2**64 - 1), "OV": (0, 2**64 - 1), "SV": (-(2**63), 2**63 - 1),
}
FLOATS = ["DS", "FL", "OF", "FD", "OD"]
#: What an error row says.
NO_JSON, NO_OBJECT, BAD_TAG, NO_VR, UNKNOWN_VR = "not JSON", "not an object", "not a tag", "no VR", "unknown VR"
BAD_BASE64, NO_LOADER, NO_ARRAY, BAD_KIND, BAD_ITEM = "InlineBinary is not base64", "BulkDataURI is not loaded", "Value is not an array", "a value of this kind is not allowed", "an item is not an object"
MIXED, BAD_NUMBER, OUT_OF_RANGE, BAD_DATE, BAD_AT = "empty and other values are mixed", "not a number", "out of range", "not a date or time", "not a tag value"


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, VOID (null), BOOLEAN, or a number's; null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _typed(rows: DataFrame) -> DataFrame:
    """Rows (file, path, depth, key, e) as element rows, `items` the variants of a sequence's items."""
    vr, inline, uri, value = _field(F.col("e"), "vr"), _field(F.col("e"), "InlineBinary"), _field(F.col("e"), "BulkDataURI"), _field(F.col("e"), "Value")
    rows = rows.withColumns({"kind": _kind(F.col("e")), "vr_kind": _kind(vr), "vr": _text(vr), "inline_kind": _kind(inline), "inline": _text(inline), "uri_kind": _kind(uri), "value_kind": _kind(value), "values": F.try_variant_get(value, "$", "array<variant>")})
    # one text for each value; a null is the empty text
    rows = rows.withColumn("kinds", F.transform("values", _kind)).withColumn("tokens", F.transform("values", lambda v: F.coalesce(_text(v), F.lit(""))))
    own, tokens, kinds = F.col("vr"), F.col("tokens"), F.col("kinds")
    scalar = F.forall(kinds, lambda k: ~k.isin("OBJECT", "ARRAY", "BOOLEAN"))
    empty, mixed = F.forall(tokens, lambda t: t == ""), F.exists(tokens, lambda t: t == "") & F.exists(tokens, lambda t: t != "")
    whole, real = own.isin(list(WHOLE)), own.isin(FLOATS)
    strict = whole | real | own.isin("DA", "TM", "DT", "UI")
    low, high = (F.coalesce(*[F.when(own == code, F.lit(str(ends[k])).cast("decimal(20,0)")) for code, ends in WHOLE.items()]) for k in (0, 1))
    digits = lambda t: t.rlike(r"^[+-]?[0-9]+$")
    in_range = lambda t: F.coalesce(t.try_cast("decimal(38,0)").between(low, high), F.lit(False))
    number = lambda t: t.rlike(r"(?i)^[+-]?([0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|inf|infinity|nan)$")
    dated = lambda parse: F.forall(tokens, lambda t: parse(t).isNotNull())
    at_ok = F.forall(F.filter(F.arrays_zip("tokens", "kinds"), lambda z: z["kinds"] == "STRING"), lambda z: z["tokens"].rlike("^[0-9A-Fa-f]{8}$"))
    inline_ok = F.try_to_binary("inline", F.lit("base64")).isNotNull()
    error = (
        F.when(~F.col("key").rlike("^[0-9A-Fa-f]{8}$"), BAD_TAG).when(F.col("kind") != "OBJECT", NO_OBJECT)
        .when(F.coalesce(F.col("vr_kind"), F.lit("")) != "STRING", NO_VR).when(~own.isin([v[0] for v in VR]), UNKNOWN_VR)
        .when(F.col("inline_kind").isNotNull(), F.when((F.col("inline_kind") != "STRING") | ~inline_ok, BAD_BASE64))
        .when(F.col("uri_kind").isNotNull(), NO_LOADER)
        .when(F.col("value_kind").isNotNull() & (F.col("value_kind") != "ARRAY"), NO_ARRAY)
        .when(own == "SQ", F.when(F.exists(kinds, lambda k: k != "OBJECT"), BAD_ITEM))
        .when(own == "PN", F.when(F.exists(kinds, lambda k: ~k.isin("OBJECT", "VOID")), BAD_KIND))
        .when(own == "AT", F.when(~at_ok, BAD_AT))
        .when(~scalar, BAD_KIND)
        .when(~strict | empty, None).when(mixed, MIXED)
        .when(whole, F.when(~F.forall(tokens, digits), BAD_NUMBER).when(~F.forall(tokens, in_range), OUT_OF_RANGE))
        .when(real, F.when(~F.forall(tokens, number), BAD_NUMBER))
        .when(own == "DA", F.when(~dated(parse_da), BAD_DATE)).when(own == "TM", F.when(~dated(parse_tm), BAD_DATE)).when(own == "DT", F.when(~dated(parse_dt), BAD_DATE))
    )
    group = lambda v, name: F.when(_kind(_field(v, name)) == "STRING", _text(_field(v, name))).otherwise("")
    names = F.transform("values", lambda v: F.rtrim(F.concat_ws("=", *[group(v, g) for g in ("Alphabetic", "Ideographic", "Phonetic")]), F.lit("=")))
    hex_tags = F.transform(F.filter(F.arrays_zip("tokens", "kinds"), lambda z: z["kinds"] == "STRING"), lambda z: F.conv(z["tokens"], 16, 10).try_cast("decimal(20,0)"))
    double = lambda t: F.when(t.rlike("(?i)^[+-]?inf"), F.when(t.startswith("-"), float("-inf")).otherwise(float("inf"))).when(t.rlike("(?i)nan"), float("nan")).otherwise(t.try_cast("double"))
    plain = F.col("error").isNull() & F.col("inline").isNull() & F.col("values").isNotNull()
    rows = rows.withColumn("error", error)
    # decimal and integer strings stay texts, as in files
    texts = F.when(own == "PN", names).when(own == "UI", F.when(~empty, F.slice(tokens, 1, 1))).when(strict, F.when(~empty, tokens)).otherwise(tokens)
    numeric = own.isin([v for v in WHOLE if v != "IS"])
    floats = own.isin([v for v in FLOATS if v != "DS"])
    return rows.select(
        "file", "path", "depth", F.conv("key", 16, 10).cast("long").alias("tag"), F.when(~F.col("error").isin(NO_VR, UNKNOWN_VR) | F.col("error").isNull(), own).alias("vr"),
        F.when(plain & (own != "SQ") & (own != "AT") & ~numeric & ~floats, texts).alias("s"),
        F.when(plain & numeric & ~empty, F.transform(tokens, lambda t: t.try_cast("decimal(20,0)"))).when(plain & (own == "AT"), hex_tags).alias("i"),
        F.when(plain & floats & ~empty, F.transform(tokens, double)).alias("f"),
        F.when(F.col("error").isNull(), F.try_to_binary("inline", F.lit("base64"))).alias("b"), "error",
        F.when(plain & (own == "SQ"), F.col("values")).alias("items"),
    )


def read_json(df: DataFrame, file: str = "file", json: str = "json") -> DataFrame:
    """Element rows, as of files (`part10.ELEMENTS`), of DICOM JSON objects, nested items too; `write_content` takes them.

    An element that breaks a rule is a row with `error` and no values: a tag that isn't eight hexadecimal digits, a missing or unknown VR, a Value
    that isn't an array, values of a kind, range or form that the VR doesn't have, empty values beside others where a VR has no empty value,
    wrong base64, a BulkDataURI. The other elements of its file are there all the same. Text that is no JSON object (null too) is one
    error row without a path. Null and empty values alone are an element without a value. A name that is there twice in an object is no JSON.
    Of several UIDs the first counts. Repeated files give repeated rows.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/json-{uuid.uuid4().hex}"
    none = F.lit(None)
    empty = {"s": none.cast("array<string>"), "i": none.cast("array<decimal(20,0)>"), "f": none.cast("array<double>"), "b": none.cast("binary")}
    columns = ["file", "path", "depth", "tag", "vr", "s", "i", "f", "b", "error"]
    given = df.select(F.col(f"`{file}`").cast("string").alias("file"), F.try_parse_json(F.col(f"`{json}`")).alias("v"))
    bad = given.where(F.coalesce(_kind(F.col("v")), F.lit("")) != "OBJECT")
    out = bad.select("file", none.cast("string").alias("path"), none.cast("int").alias("depth"), none.cast("long").alias("tag"), none.cast("string").alias("vr"), *[c.alias(n) for n, c in empty.items()], F.when(F.col("v").isNull(), NO_JSON).otherwise(NO_OBJECT).alias("error"))
    level, depth = given.where(_kind(F.col("v")) == "OBJECT").select("file", F.lit("").alias("at"), "v"), 0
    while True:
        members = level.select("file", "at", F.explode(F.try_variant_get("v", "$", "map<string, variant>")).alias("key", "e"))
        rows = _typed(members.select("file", F.concat("at", F.upper("key")).alias("path"), F.lit(depth).alias("depth"), "key", "e"))
        rows.write.parquet(f"{folder}/{depth}")
        rows = spark.read.parquet(f"{folder}/{depth}")
        out = out.unionByName(rows.select(columns))
        if rows.where("size(items) > 0").isEmpty():
            return out
        depth += 1
        items = rows.select("file", "path", F.posexplode("items").alias("n", "v")).select("file", F.concat("path", F.lit("/"), F.col("n").cast("string")).alias("path"), "v")
        out = out.unionByName(items.select("file", "path", F.lit(depth).alias("depth"), F.lit(ITEM).cast("long").alias("tag"), F.lit("").alias("vr"), *[c.alias(n) for n, c in empty.items()], none.cast("string").alias("error")))
        level = items.select("file", F.concat("path", F.lit("/")).alias("at"), "v")
