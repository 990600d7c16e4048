"""Attribute tags (group * 65536 + element) as Column expressions. A null tag gives null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def group(tag: Column) -> Column:
    return F.floor(tag / 65536).cast("long")


def element(tag: Column) -> Column:
    return tag % 65536


def is_group_length(tag: Column) -> Column:
    return element(tag) == 0


def is_private(tag: Column) -> Column:
    """Groups of odd number."""
    return group(tag) % 2 == 1


def is_file_meta(tag: Column) -> Column:
    return group(tag) == 2


def is_delimiter(tag: Column) -> Column:
    """An item, its end or the end of a sequence."""
    return tag.isin(0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD)


def is_item(tag: Column) -> Column:
    return tag == 0xFFFEE000


def text(tag: Column) -> Column:
    """`(gggg,eeee)` in lower-case hexadecimal digits."""
    h = F.lower(F.lpad(F.hex(tag), 8, "0"))
    return F.concat(F.lit("("), F.substring(h, 1, 4), F.lit(","), F.substring(h, 5, 4), F.lit(")"))


def parsed(c: Column) -> Column:
    """The tag of `(gggg,eeee)`, `gggg,eeee` or `ggggeeee`, blanks around it aside; null where the text is none of these."""
    plain = F.trim(c)
    digits = F.regexp_extract(plain, r"^\(?([0-9A-Fa-f]{4}),?([0-9A-Fa-f]{4})\)?$", 1), F.regexp_extract(plain, r"^\(?([0-9A-Fa-f]{4}),?([0-9A-Fa-f]{4})\)?$", 2)
    fits = plain.rlike(r"^(\([0-9A-Fa-f]{4},[0-9A-Fa-f]{4}\)|[0-9A-Fa-f]{4},?[0-9A-Fa-f]{4})$")
    return F.when(fits, F.conv(F.concat(*digits), 16, 10).cast("long"))
