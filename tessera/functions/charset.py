"""DICOM character sets: defined terms to codecs, ISO 2022 escapes, as small helpers of Arrow functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

# Fixed values of the standard (PS3.3 C.12.1.1.2): defined term, codec.
TERMS = {
    "": "ascii", "ISO_IR 6": "ascii", "ISO_IR 100": "latin-1", "ISO_IR 101": "iso8859-2", "ISO_IR 109": "iso8859-3", "ISO_IR 110": "iso8859-4",
    "ISO_IR 144": "iso8859-5", "ISO_IR 127": "iso8859-6", "ISO_IR 126": "iso8859-7", "ISO_IR 138": "iso8859-8", "ISO_IR 148": "iso8859-9",
    "ISO_IR 13": "shift_jis", "ISO_IR 166": "tis-620", "ISO_IR 192": "utf-8", "GB18030": "gb18030", "GBK": "gbk",
    "ISO 2022 IR 6": "ascii", "ISO 2022 IR 100": "latin-1", "ISO 2022 IR 101": "iso8859-2", "ISO 2022 IR 109": "iso8859-3", "ISO 2022 IR 110": "iso8859-4",
    "ISO 2022 IR 144": "iso8859-5", "ISO 2022 IR 127": "iso8859-6", "ISO 2022 IR 126": "iso8859-7", "ISO 2022 IR 138": "iso8859-8", "ISO 2022 IR 148": "iso8859-9",
    "ISO 2022 IR 13": "shift_jis", "ISO 2022 IR 166": "tis-620", "ISO 2022 IR 87": "iso2022_jp", "ISO 2022 IR 159": "iso2022_jp_1", "ISO 2022 IR 149": "euc_kr", "ISO 2022 IR 58": "gb2312",
}
# Fixed values of the standard (PS3.3 table C.12-4): escape sequence after ESC, codec.
ESCAPES = {
    b"(B": "ascii", b"-A": "latin-1", b"-B": "iso8859-2", b"-C": "iso8859-3", b"-D": "iso8859-4", b"-L": "iso8859-5", b"-G": "iso8859-6", b"-F": "iso8859-7",
    b"-H": "iso8859-8", b"-M": "iso8859-9", b"-T": "tis-620", b")I": "shift_jis", b"(J": "shift_jis", b"$B": "iso2022_jp", b"$(D": "iso2022_jp_1", b"$)C": "euc_kr", b"$)A": "gb2312",
}
_SEGMENT = re.compile(rb"\x1b(\$\([A-D]|\$\)[AC]|\$B|[()\-][A-Z])")


def codec_of(term: str) -> str:
    if term.strip() not in TERMS:
        raise LookupError(f"unknown character set {term!r}")
    return TERMS[term.strip()]


def decode_bytes(raw: bytes, charset: str) -> str:
    """Text of a value under (0008,0005); with several terms, escape sequences switch until a control character or backslash."""
    terms = charset.split("\\")
    first = codec_of(terms[0])
    if len(terms) == 1:
        return raw.decode("latin-1" if first == "ascii" else first, "replace")
    out = []
    for line in re.split(rb"(?<=[\r\n\f\t\\^=])", raw):
        codec, at = first, 0
        for m in [*_SEGMENT.finditer(line), None]:
            part = line[at : m.start() if m else len(line)]
            if part:
                wrapped = {"iso2022_jp": b"\x1b$B" + part + b"\x1b(B", "iso2022_jp_1": b"\x1b$(D" + part + b"\x1b(B"}.get(codec, part)
                out.append(wrapped.decode("latin-1" if codec == "ascii" else codec, "replace"))
            if m:
                codec, at = ESCAPES.get(m.group(1), codec), m.end()
    return "".join(out)


def encode_text(text: str, charset: str) -> bytes:
    """Bytes under the first term alone; a character that it lacks is an error."""
    return text.encode(codec_of(charset.split("\\")[0]))


def decode(raw: Column, charset: str) -> Column:
    """A binary column as text. Latin-1 and UTF-8 stay in the JVM, the rest goes through Arrow batches."""
    if charset in ("ISO_IR 100", "ISO_IR 192"):
        return F.decode(raw, "ISO-8859-1" if charset == "ISO_IR 100" else "UTF-8")

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else decode_bytes(b, charset))

    return run(raw)


def encode(text: Column, charset: str) -> Column:
    """Text as bytes; null where a character can't be encoded. Latin-1 and UTF-8 stay in the JVM, the rest goes through Arrow batches."""
    if charset == "ISO_IR 192":
        return F.encode(text, "UTF-8")
    if charset == "ISO_IR 100":
        return F.when(~text.rlike(r"[^\x00-\xFF]"), F.encode(text, "ISO-8859-1"))

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else encode_text(t, charset)
            except UnicodeEncodeError:
                return None

        return s.map(one)

    return run(text)
