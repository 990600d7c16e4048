"""Parsing and rendering of DICOM values as Column expressions. What doesn't parse is null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UID_PATTERN = r"^(0|[1-9][0-9]*)(\.(0|[1-9][0-9]*))*$"


def _int(c: Column) -> Column:
    return c.cast("int")


def parse_da(c: Column) -> Column:
    """struct(y, m, d) of YYYY, YYYYMM, YYYYMMDD or YYYY.MM.DD; missing parts are 0 and the calendar isn't checked."""
    plain = F.when(c.rlike(r"^[0-9]{4}\.[0-9]{2}\.[0-9]{2}$"), F.replace(c, F.lit("."), F.lit(""))).otherwise(c)
    part = lambda at, n: F.when(F.length(plain) >= at + n - 1, _int(F.substring(plain, at, n))).otherwise(0)
    return F.when(plain.rlike(r"^[0-9]{4}([0-9]{2}){0,2}$"), F.struct(part(1, 4).alias("y"), part(5, 2).alias("m"), part(7, 2).alias("d")))


def parse_tm(c: Column) -> Column:
    """struct(h, m, s, us) of HH, HHMM or HHMMSS with a fraction of up to six digits, which counts only after seconds."""
    whole = F.regexp_extract(c, r"^([0-9]+)", 1)
    fraction = F.regexp_extract(c, r"^[0-9]{6}\.([0-9]{1,6})$", 1)
    part = lambda at: F.when(F.length(whole) >= at + 1, _int(F.substring(whole, at, 2))).otherwise(0)
    us = F.when(fraction == "", 0).otherwise(_int(F.rpad(fraction, 6, "0")))
    time = F.struct(part(1).alias("h"), part(3).alias("m"), part(5).alias("s"), us.alias("us"))
    fits = c.rlike(r"^([0-9]{2}){1,3}(\.[0-9]{1,6})?$") & (part(1) <= 23) & (part(3) <= 59) & (part(5) <= 59)
    return F.when(fits, time)


def parse_dt(c: Column) -> Column:
    """struct(date, time, offset_min): a date of up to eight digits, a time, and an optional +HHMM or -HHMM."""
    offset = F.regexp_extract(c, r"([+-][0-9]{4})$", 1)
    body = F.when(offset == "", c).otherwise(F.substring(c, F.lit(1), F.length(c) - 5))
    date, time = F.substring(body, 1, 8), F.substring(body, F.lit(9), F.greatest(F.length(body) - 8, F.lit(0)))
    minutes = _int(F.substring(offset, 2, 2)) * 60 + _int(F.substring(offset, 4, 2))
    signed = F.when(offset == "", None).when(offset.startswith("-"), -minutes).otherwise(minutes)
    day = parse_da(date)
    return F.when(day.isNotNull() & ((time == "") | parse_tm(time).isNotNull()), F.struct(day.alias("date"), F.when(time != "", parse_tm(time)).alias("time"), signed.alias("offset_min")))


def format_da(d: Column) -> Column:
    """A parsed date at its own precision."""
    return F.concat(F.lpad(d["y"].cast("string"), 4, "0"), F.when(d["m"] > 0, F.lpad(d["m"].cast("string"), 2, "0")).otherwise(""), F.when(d["d"] > 0, F.lpad(d["d"].cast("string"), 2, "0")).otherwise(""))


def format_tm(t: Column) -> Column:
    return F.concat(*[F.lpad(t[k].cast("string"), 2, "0") for k in ("h", "m", "s")], F.when(t["us"] > 0, F.concat(F.lit("."), F.lpad(t["us"].cast("string"), 6, "0"))).otherwise(""))


def person_groups(c: Column) -> Column:
    """struct(alphabetic, ideographic, phonetic), the up to three groups of a person name."""
    groups = F.split(c, "=", 3)
    return F.struct(*[F.coalesce(F.get(groups, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(("alphabetic", "ideographic", "phonetic"))])


def person_component(group: Column, index: int) -> Column:
    """Family (0), given, middle name, prefix or suffix (4) of a group; empty where it is missing."""
    return F.coalesce(F.get(F.split(group, r"\^"), F.lit(index)), F.lit(""))


def format_person(groups: Column) -> Column:
    return F.regexp_replace(F.concat_ws("=", groups["alphabetic"], groups["ideographic"], groups["phonetic"]), "=+$", "")


def uid_valid(c: Column) -> Column:
    """Nonempty, at most 64 characters, digits in dot-separated components without leading zeros."""
    return F.coalesce((F.length(c) <= 64) & c.rlike(UID_PATTERN), F.lit(False))


def uid_from_text(root: str, c: Column) -> Column:
    """A UID below `root` that a text fixes: the decimal of the upper 60 bits of its SHA-256."""
    return F.substring(F.concat(F.lit(root + "."), F.conv(F.substring(F.sha2(c, 256), 1, 15), 16, 10)), 1, 64)


def format_number(c: Column) -> Column:
    """Whole doubles below 1e15 with one decimal, others as they are."""
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), F.concat(c.cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(c.cast("string"))


def truncated(c: Column, most: int = 64) -> Column:
    """At most `most` characters, then `...`."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def dump_line(tag: Column, vr: Column, value: Column, vm: Column) -> Column:
    """`(gggg,eeee) VR [value] # length, vm`"""
    h = F.lower(F.lpad(F.hex(tag), 8, "0"))
    return F.concat(F.lit("("), F.substring(h, 1, 4), F.lit(","), F.substring(h, 5, 4), F.lit(") "), vr, F.lit(" ["), truncated(value), F.lit("] # "), F.length(value).cast("string"), F.lit(", "), vm.cast("string"))


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def pad_even(c: Column, pad: Column) -> Column:
    return F.when(F.length(c) % 2 == 1, F.concat(c, pad)).otherwise(c)


def status_class(c: Column) -> Column:
    """success, pending, cancel, warning (0001) or failure; every other code, 0xBxxx among them, counts as failure."""
    return F.when(c == 0, "success").when(c.isin(0xFF00, 0xFF01), "pending").when(c == 0xFE00, "cancel").when(c == 1, "warning").otherwise("failure")


def format_dt(dt: Column) -> Column:
    """A parsed date and time at its own precision, with its offset as +HHMM or -HHMM where it has one."""
    off = dt["offset_min"]
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    shown = F.when(off.isNull(), "").otherwise(F.concat(F.when(off < 0, "-").otherwise("+"), two(F.abs(off) / 60), two(F.abs(off) % 60)))
    return F.concat(format_da(dt["date"]), F.when(dt["time"].isNull(), "").otherwise(format_tm(dt["time"])), shown)


def format_ds(c: Column) -> Column:
    """A double as a decimal string of at most 16 characters: as it is where that fits, else with an exponent and six or four decimals; 0 where it
    isn't finite."""
    whole = F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("decimal(20,0)").cast("string"))
    plain = F.coalesce(whole, c.cast("string"))
    six, four = F.format_string("%.6E", c), F.format_string("%.4E", c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), "0").when(F.length(plain) <= 16, plain).when(F.length(six) <= 16, six).otherwise(four)


def encoded_length(vr: Column, s: Column, i: Column, f: Column, b: Column) -> Column:
    """Bytes of an element's value as it is written, padded to an even number. 0 for an empty one."""
    size = F.when(vr.isin("US", "SS", "OW"), 2).when(vr.isin("UL", "SL", "AT", "OL", "FL", "OF"), 4).otherwise(8)
    n = F.coalesce(F.octet_length(F.array_join(s, "\\")), F.size(i) * size, F.size(f) * size, F.octet_length(b), F.lit(0))
    return (n + n % 2).cast("int")


def is_empty(s: Column, i: Column, f: Column, b: Column) -> Column:
    """True where an element has no value: none at all, or one without entries, characters or bytes."""
    return F.coalesce(F.octet_length(F.array_join(s, "")), F.size(i), F.size(f), F.octet_length(b), F.lit(0)) == 0
