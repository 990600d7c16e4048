"""The image module of a data set: from element rows to one row for each frame, and stored values out of pixel bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Fixed values of the standard: attribute, tag, default where it is missing (None: mandatory).
MODULE = [
    ("rows", 0x00280010, None), ("cols", 0x00280011, None), ("bits_allocated", 0x00280100, None), ("samples", 0x00280002, 1),
    ("bits_stored", 0x00280101, 0), ("high_bit", 0x00280102, -1), ("signed", 0x00280103, 0), ("planar", 0x00280006, 0),
]


def image_module(elements: DataFrame) -> DataFrame:
    """One row for each file: geometry, bit depths with their defaults, photometric interpretation, frames, window, rescale and pixel bytes.

    `error` names a missing mandatory attribute. Partial sums of a few values are all that is exchanged besides the pixel bytes.
    """
    of = lambda tag, c: F.max(F.when(F.col("tag") == tag, c))
    number = lambda tag: of(tag, F.get("i", F.lit(0)).cast("int"))
    decimal = lambda tag: of(tag, F.coalesce(F.expr("try_cast(trim(get(s, 0)) AS DOUBLE)"), F.get("f", F.lit(0))))
    wanted = [tag for _, tag, _ in MODULE] + [0x00280004, 0x00280008, 0x00281050, 0x00281051, 0x00281052, 0x00281053, 0x7FE00010]
    out = elements.where(F.col("tag").isin(wanted) & (F.col("depth") == 0)).groupBy("file").agg(
        *[number(tag).alias(name) for name, tag, _ in MODULE],
        of(0x00280004, F.trim(F.get("s", F.lit(0)))).alias("photometric"),
        F.greatest(F.lit(1), F.coalesce(of(0x00280008, F.expr("try_cast(trim(get(s, 0)) AS INT)")), F.lit(1))).alias("frames"),
        decimal(0x00281050).alias("center"), decimal(0x00281051).alias("width"), decimal(0x00281052).alias("intercept"), decimal(0x00281053).alias("slope"),
        of(0x7FE00010, F.col("b")).alias("pixels"),
    )
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n, _, default in MODULE if default is None])), ", ")
    out = out.withColumn("error", F.when(missing != "", missing))
    for name, _, default in MODULE:
        if default is not None:
            value = F.col("bits_allocated") if name == "bits_stored" else F.col("bits_stored") - 1 if name == "high_bit" else F.lit(default)
            out = out.withColumn(name, F.coalesce(name, value))
    return out.withColumns({"slope": F.coalesce("slope", F.lit(1.0)), "intercept": F.coalesce("intercept", F.lit(0.0)), "photometric": F.coalesce("photometric", F.lit("MONOCHROME2"))})


def frame_bytes(images: DataFrame) -> DataFrame:
    """One row for each frame of native pixel data, with its number from 0 and its slice of the bytes."""
    size = F.col("rows") * F.col("cols") * F.col("samples") * F.ceil(F.col("bits_allocated") / 8).cast("int")
    out = images.where("error IS NULL AND pixels IS NOT NULL").withColumn("frame", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)))
    return out.withColumn("pixels", F.substring("pixels", F.col("frame") * size + 1, size)).where(F.length("pixels") == size)


def stored_values(pixels: Column, bits_allocated: Column, signed: Column) -> Column:
    """Little-endian samples of 8 or 16 bits as integers, decoded in Arrow batches."""

    @F.pandas_udf("array<int>")
    def run(p: pd.Series, bits: pd.Series, sign: pd.Series) -> pd.Series:
        kind = lambda b, s: "u1" if b <= 8 else "<i2" if s else "<u2"
        return pd.Series([None if x is None else np.frombuffer(bytes(x), kind(b, s)).astype(np.int32) for x, b, s in zip(p, bits, sign, strict=True)])

    return run(pixels, bits_allocated, signed)


def overlay_groups(elements: DataFrame) -> DataFrame:
    """The distinct even groups 6000 to 601E that each file has, ascending."""
    group = F.floor(F.col("tag") / 65536)
    own = elements.where((F.col("depth") == 0) & group.between(0x6000, 0x601E) & (group % 2 == 0))
    return own.groupBy("file").agg(F.array_sort(F.collect_set(group)).alias("groups"))


def overlays(elements: DataFrame) -> DataFrame:
    """(file, group, rows, cols, origin_row, origin_col, data): each overlay plane that has rows, columns and data.

    Groups are 6000 to 601E, even. The origin is (1, 1) where it is missing. Data are the packed bits. Null values count as missing.
    """
    group = F.floor(F.col("tag") / 65536).cast("int")
    own = elements.where((F.col("depth") == 0) & group.between(0x6000, 0x601E) & (group % 2 == 0)).withColumn("element", F.col("tag") % 65536)
    of = lambda e, c: F.max(F.when(F.col("element") == e, c))
    number = lambda e, k: of(e, F.get("i", F.lit(k)).cast("int"))
    out = own.groupBy("file", group.alias("group")).agg(
        number(0x10, 0).alias("rows"), number(0x11, 0).alias("cols"), F.coalesce(number(0x50, 0), F.lit(1)).alias("origin_row"), F.coalesce(number(0x50, 1), F.lit(1)).alias("origin_col"), of(0x3000, F.col("b")).alias("data"))
    return out.where("rows IS NOT NULL AND cols IS NOT NULL AND data IS NOT NULL")


def palettes(elements: DataFrame) -> DataFrame:
    """(file, channel, first, n, bits, table, error): red, green and blue lookup tables from their descriptors and data.

    A descriptor is (entries, first value, bits); 0 entries are 65,536. Data are 16-bit words, little endian. `error` names what is missing or not as long as
    the descriptor says; files without any descriptor have no row.
    """
    channel = F.when(F.col("tag").isin(0x00281101, 0x00281201), "red").when(F.col("tag").isin(0x00281102, 0x00281202), "green").when(F.col("tag").isin(0x00281103, 0x00281203), "blue")
    own = elements.where("depth = 0").withColumn("channel", channel).where("channel IS NOT NULL")
    described = F.col("tag") < 0x00281200
    part = lambda k: F.max(F.when(described, F.get("i", F.lit(k)).cast("int")))
    data = F.max(F.when(~described, F.coalesce(F.transform("i", lambda x: x.cast("int")), _words("b"))))
    out = own.groupBy("file", "channel").agg(part(0).alias("n"), part(1).alias("first"), part(2).alias("bits"), data.alias("table"))
    out = out.withColumn("n", F.when(F.col("n") == 0, 65536).otherwise(F.col("n")))
    error = F.when(F.col("n").isNull() | F.col("bits").isNull(), "no descriptor").when(F.col("table").isNull(), "no data").when(F.size("table") != F.col("n"), "data and descriptor differ")
    return out.select("file", "channel", "first", "n", "bits", "table", error.alias("error"))


def _words(data: str) -> Column:
    """16-bit little-endian words of a binary column."""
    at = F.sequence(F.lit(0), F.floor(F.octet_length(data) / 2).cast("int") - 1)
    word = lambda k: F.conv(F.concat(F.hex(F.substring(data, 2 * k + 2, F.lit(1))), F.hex(F.substring(data, 2 * k + 1, F.lit(1)))), 16, 10).cast("int")
    return F.when(F.octet_length(data) >= 2, F.transform(at, word))
