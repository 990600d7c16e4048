"""Query/retrieve attribute matching as Column predicates, which Catalyst can push down."""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import date, timedelta

from pyspark.sql import Column, functions as F, types as T

from tessera.functions.values import parse_da


def like_pattern(key: str) -> str:
    """A `*`/`?` key as a LIKE pattern. `?` is one character."""
    out = []
    for c in key:
        out.append({"*": "%", "?": "_"}.get(c, "\\" + c if c in "%_\\" else c))
    return "".join(out)


def wildcard(c: Column, key: str) -> Column:
    """True where the value matches the key: `*` any run, `?` one character; the empty key matches everything. Case counts."""
    return F.lit(True) if key == "" else c.like(like_pattern(key))


def uid_list(c: Column, key: str) -> Column:
    """True where the value is one of a backslash-separated list of UIDs; the empty key matches everything."""
    return F.lit(True) if key == "" else c.isin(key.split("\\"))


def _bounds(key: str) -> tuple[str | None, str | None]:
    if "-" not in key:
        return key, key
    low, high = key.split("-", 1)
    return low or None, high or None


def date_range(c: Column, key: str) -> Column:
    """True where a DA value lies in `D`, `D1-D2`, `-D` or `D-`; the empty key matches every date that parses.

    Partial dates order by missing part = 0. A bound that doesn't parse is open; a candidate that doesn't parse never matches.
    """
    date = parse_da(c)
    fits = date.isNotNull()
    if key == "":
        return fits
    low, high = _bounds(key)
    if low is not None:
        bound = parse_da(F.lit(low))
        fits = fits & (bound.isNull() | (date >= bound))
    if high is not None:
        bound = parse_da(F.lit(high))
        fits = fits & (bound.isNull() | (date <= bound))
    return F.coalesce(fits, F.lit(False))


def single_value(c: Column, key: str) -> Column:
    """True where the value is the key; the empty key matches everything."""
    return F.lit(True) if key == "" else c == key


def _day(key: str, past: bool) -> date | None:
    """The first day that isn't before a partial date, or with `past` the first that is after it; null where it doesn't parse."""
    plain = key.replace(".", "") if re.fullmatch(r"[0-9]{4}\.[0-9]{2}\.[0-9]{2}", key) else key
    if not re.fullmatch(r"[0-9]{4}([0-9]{2}){0,2}", plain):
        return None
    y, m, d = int(plain[:4]), int(plain[4:6] or 0), int(plain[6:8] or 0)
    if not 0 < y < 9999:
        return None
    if m == 0:
        return date(y, 1, 1)
    if m > 12:
        return date(y + 1, 1, 1)
    if d == 0:
        return date(y, m, 1)
    if d > monthrange(y, m)[1]:
        return date(y, m, 1) + timedelta(days=monthrange(y, m)[1])
    return date(y, m, d) + timedelta(days=int(past))


def typed_date_range(c: Column, key: str) -> Column:
    """`date_range` for a column of dates or timestamps, by two bounds that a scan can prune by."""
    fits = c.isNotNull()
    if key == "":
        return fits
    low, high = (None if b is None else _day(b, past) for b, past in zip(_bounds(key), (False, True), strict=True))
    fits = fits if low is None else fits & (c >= F.lit(low))
    return fits if high is None else fits & (c < F.lit(high))


def typed_uid_list(c: Column, key: str) -> Column:
    """`uid_list` for a column of whole numbers, as a list of numbers; entries that aren't written like one match nothing."""
    return F.lit(True) if key == "" else c.isin([int(k) for k in key.split("\\") if re.fullmatch(r"0|-?[1-9][0-9]{0,18}", k)])


def is_date(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_whole(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
