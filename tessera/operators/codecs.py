"""Pixel codecs as a registry: which codec reads or writes a transfer syntax, and objects sent to it row by row.

A registry is a list of codecs in the order of their registration; for each syntax and direction the one that was registered last counts. Objects are
coded in one pass: every codec sees the data of its own rows and null for the others, and what no codec takes, or no depth allows, is an error row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions import rle

#: Columns that an object's description has beside its data.
SHAPE = ["rows", "cols", "samples", "bits_allocated", "bits_stored"]


@dataclass(frozen=True)
class Codec:
    """decode and encode get data (bytes) and give the other form; null where the data can't be coded. They may use the columns SHAPE."""

    name: str
    decodes: tuple[str, ...]
    encodes: tuple[str, ...]
    decode: Callable[[Column], Column] | None = None
    encode: Callable[[Column], Column] | None = None


def width() -> Column:
    """Bytes of a sample."""
    return F.ceil(F.col("bits_allocated") / 8).cast("int")


def frame_bytes() -> Column:
    return F.col("rows").cast("long") * F.col("cols") * F.col("samples") * width()


def _whole(data: Column) -> Column:
    return F.when(F.octet_length(data) >= frame_bytes(), F.substring(data, F.lit(1), frame_bytes().cast("int")))


# Fixed values of the standard (PS3.5 annex A): the transfer syntaxes of native little-endian data and of run lengths.
NATIVE = Codec("native", ("1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.1.99"), ("1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.1.99"), _whole, _whole)
RLE = Codec(
    "rle", ("1.2.840.10008.1.2.5",), ("1.2.840.10008.1.2.5",),
    lambda data: rle.rle_decode(data, F.col("rows").cast("long") * F.col("cols"), F.col("samples"), width()), lambda data: rle.rle_encode(_whole(data), F.col("samples"), width()),
)
BUILT_IN = (NATIVE, RLE)


def winners(codecs: list[Codec], direction: str) -> dict[str, Codec]:
    """The codec of each transfer syntax; direction is `decodes`, `encodes`, or `both` for those that do both."""
    out = {}
    for c in codecs:
        own = set(c.decodes) & set(c.encodes) if direction == "both" else set(getattr(c, direction))
        out |= dict.fromkeys(sorted(own), c)
    return out


def registry(spark: SparkSession, codecs: list[Codec]) -> DataFrame:
    """(uid, decoder, encoder, codec): names of the codecs that count for each syntax, null where there is none; codec is that which does both."""
    by = {d: winners(codecs, d) for d in ("decodes", "encodes", "both")}
    name = lambda d, uid: by[d][uid].name if uid in by[d] else None
    uids = sorted(set(by["decodes"]) | set(by["encodes"]))
    return spark.createDataFrame([(u, name("decodes", u), name("encodes", u), name("both", u)) for u in uids], "uid string, decoder string, encoder string, codec string")


def _coded(df: DataFrame, codecs: list[Codec], direction: str, uid: str, data: str, out: str) -> DataFrame:
    by = winners(codecs, direction)
    chosen = list(dict.fromkeys(by.values()))
    mine = {c: F.col(uid).isin([u for u, w in by.items() if w is c]) for c in chosen}
    name = F.coalesce(*[F.when(mine[c], c.name) for c in chosen]) if chosen else F.lit(None).cast("string")
    depth = (
        F.when(F.coalesce(F.col("bits_stored"), F.lit(0)) < 1, "BitsStored must be at least 1")
        .when(F.col("bits_stored") > F.coalesce(F.col("bits_allocated"), F.lit(0)), "BitsStored exceeds BitsAllocated")
    )
    refused = F.when(name.isNull(), F.concat(F.lit("no codec for "), F.coalesce(F.col(uid), F.lit("no transfer syntax")))).otherwise(depth)
    kept = [c for c in df.columns if c not in ("codec", "error", out)]
    own = df.withColumn("__error", refused)
    act = {c: c.decode if direction == "decodes" else c.encode for c in chosen}
    results = [act[c](F.when(mine[c] & F.col("__error").isNull(), F.col(data))) for c in chosen if act[c] is not None]
    own = own.withColumn("__out", F.coalesce(*results) if results else F.lit(None).cast("binary"))
    error = F.coalesce("__error", F.when(F.col("__out").isNull(), "the data can't be coded"))
    return own.select(*kept, name.alias("codec"), F.col("__out").alias(out), error.alias("error"))


def decoded(df: DataFrame, codecs: list[Codec], uid: str = "uid", data: str = "data", out: str = "pixels") -> DataFrame:
    """Adds codec, `out` and error: the pixels of a frame by the codec that reads its transfer syntax, or why there are none.

    df: the columns SHAPE beside uid and data. Null data, data too short or damaged, syntaxes without a codec and impossible depths are
    rows with an error; every row stays. Columns of these names are replaced.
    """
    return _coded(df, codecs, "decodes", uid, data, out)


def encoded(df: DataFrame, codecs: list[Codec], uid: str = "uid", data: str = "pixels", out: str = "data") -> DataFrame:
    """The other way: pixels coded by the codec that writes the transfer syntax."""
    return _coded(df, codecs, "encodes", uid, data, out)
