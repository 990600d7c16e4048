"""DICOM Part 10 files as tables: binary files in, one row for each element out, and back.

`read_elements` scans files with Spark's binaryFile source and parses each in the task that read it; nested items become rows whose
path names the way to them (00081115/0/00081155), since Spark's schemas can't recurse; every item is a row of its own too
(00081115/0, tag FFFEE000, no VR), so empty ones are kept. `tags` prunes while parsing: other elements, pixel data above all,
are skipped without being copied. A file that can't be parsed is one row with `error` set.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.charset import decode_bytes
from tessera.plans.dims import TAG, TRANSFER_SYNTAX, VR

ELEMENTS = "file string, path string, depth int, tag long, vr string, s array<string>, i array<decimal(20,0)>, f array<double>, b binary, error string"
#: Nested items deeper than this are an error: lengths and depths of untrusted files are bounded.
MOST_DEPTH = 32
UNDEFINED = 0xFFFFFFFF
_ITEM, _ITEM_END, _SEQUENCE_END = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD
_VR_OF = {g << 16 | e: vr for g, e, vr, _ in TAG}
_LONG = {code for code, _, _, long_, _, _ in VR if long_}
_PAD = {code: bytes([pad]) for code, _, _, _, pad, _ in VR}
_SYNTAX = {uid: (little, explicit, deflated) for uid, _, little, explicit, _, deflated in TRANSFER_SYNTAX}
_NUMBERS = {"US": "H", "OW": "H", "SS": "h", "UL": "I", "OL": "I", "SL": "i", "UV": "Q", "OV": "Q", "SV": "q", "FL": "f", "OF": "f", "FD": "d", "OD": "d"}
_LISTS, _TEXTS = {"AE", "AS", "CS", "LO", "SH", "DA", "TM", "DT", "IS", "DS", "PN"}, {"LT", "ST", "UT", "UC", "UR", "UI"}


class Parser:
    """One data set in one encoding; `rows` gives (path, depth, tag, vr, value bytes)."""

    def __init__(self, data: bytes, little: bool, explicit: bool, wanted: frozenset[int] | None):
        self.data, self.little, self.explicit, self.wanted = data, little, explicit, wanted
        self.order = "<" if little else ">"

    def number(self, at: int, kind: str) -> int:
        if at + struct.calcsize(kind) > len(self.data):
            raise ValueError(f"the data end within an element at byte {at}")
        return struct.unpack_from(self.order + kind, self.data, at)[0]

    def header(self, at: int) -> tuple[int, str, int, int]:
        """(tag, vr, length, start of the value)"""
        tag = self.number(at, "H") << 16 | self.number(at + 2, "H")
        if tag in (_ITEM, _ITEM_END, _SEQUENCE_END):
            return tag, "", self.number(at + 4, "I"), at + 8
        if not self.explicit:
            vr = "UL" if tag & 0xFFFF == 0 else _VR_OF.get(tag, "UN")
            return tag, vr, self.number(at + 4, "I"), at + 8
        vr = self.data[at + 4 : at + 6].decode("latin-1")
        if vr in _LONG or vr not in _PAD:
            return tag, vr if vr in _PAD else "UN", self.number(at + 8, "I"), at + 12
        return tag, vr, self.number(at + 6, "H"), at + 8

    def rows(self, at: int, end: int, path: str = "", depth: int = 0, out: list | None = None) -> tuple[list, int]:
        """Elements from `at` on, and where they end: at `end` or behind a delimiter."""
        if depth > MOST_DEPTH:
            raise ValueError("items are nested too deeply")
        out = [] if out is None else out
        while at < end:
            tag, vr, length, start = self.header(at)
            if tag in (_ITEM_END, _SEQUENCE_END):
                return out, start
            own = f"{path}{tag:08X}"
            if length == UNDEFINED and tag == 0x7FE00010:
                at = self.fragments(start, own, depth, out)
            elif vr == "SQ" or length == UNDEFINED:
                inner = self if vr != "UN" else Parser(self.data, True, False, self.wanted)
                out.append((own, depth, tag, "SQ", b""))
                at = inner.items(start, end if length == UNDEFINED else start + length, own, depth, out, length == UNDEFINED)
            else:
                if start + length > len(self.data):
                    raise ValueError(f"element {tag:08X} is longer than the data")
                if self.wanted is None or tag in self.wanted:
                    out.append((own, depth, tag, vr, self.data[start : start + length]))
                at = start + length
        return out, at

    def items(self, at: int, end: int, path: str, depth: int, out: list, open_: bool) -> int:
        k = 0
        while at < end:
            tag, _, length, start = self.header(at)
            if tag == _SEQUENCE_END:
                return start
            if tag != _ITEM:
                raise ValueError(f"an item was expected, not {tag:08X}")
            out.append((f"{path}/{k}", depth + 1, _ITEM, "", b""))
            _, at = self.rows(start, len(self.data) if length == UNDEFINED else start + length, f"{path}/{k}/", depth + 1, out)
            k += 1
        return at

    def fragments(self, at: int, path: str, depth: int, out: list) -> int:
        """Encapsulated pixel data: the offset table is item 0, the fragments the items behind it."""
        k = 0
        while True:
            tag, _, length, start = self.header(at)
            if tag == _SEQUENCE_END:
                return start
            if tag != _ITEM or start + length > len(self.data):
                raise ValueError("a fragment was expected")
            if self.wanted is None or 0x7FE00010 in self.wanted:
                out.append((f"{path}/{k}", depth, 0x7FE00010, "OB", self.data[start : start + length]))
            at, k = start + length, k + 1


def parse_file(data: bytes, wanted: frozenset[int] | None = None) -> list[tuple[str, int, int, str, bytes, bool]]:
    """Elements of a file, meta group first: behind a preamble, without one, or a bare implicit little-endian data set."""
    at = 132 if data[128:132] == b"DICM" else 0
    meta: list = []
    syntax = "1.2.840.10008.1.2"
    if at or data[:2] == b"\x02\x00":
        head = Parser(data, True, True, None)
        while at < len(data) and head.number(at, "H") == 2:
            tag, vr, length, start = head.header(at)
            meta.append((f"{tag:08X}", 0, tag, vr, data[start : start + length], True))
            at = start + length
        syntax = next((v.rstrip(b"\0 ").decode("latin-1") for _, _, tag, _, v, _ in meta if tag == 0x00020010), "1.2.840.10008.1.2.1")
    little, explicit, deflated = _SYNTAX.get(syntax, (True, True, False))
    body = zlib.decompressobj(-15).decompress(data[at:]) if deflated else data[at:]
    keep = None if wanted is None else wanted | {0x00080005}
    rows, _ = Parser(body, little, explicit, keep).rows(0, len(body))
    return [r for r in meta if wanted is None or r[2] in wanted] + [(*r, little) for r in rows]


def decoded(vr: str, raw: bytes, little: bool, charset: str) -> tuple:
    """(s, i, f, b) of an element's bytes; an empty value has none of them."""
    if not raw or vr == "SQ":
        return None, None, None, None
    if vr == "AT":
        n = len(raw) // 4
        v = struct.unpack(("<" if little else ">") + "HH" * n, raw[: 4 * n])
        return None, [v[2 * k] << 16 | v[2 * k + 1] for k in range(n)], None, None
    if vr in _NUMBERS and vr not in ("OW",):
        kind = _NUMBERS[vr]
        n = len(raw) // struct.calcsize(kind)
        v = list(struct.unpack(("<" if little else ">") + kind * n, raw[: n * struct.calcsize(kind)]))
        return (None, None, v, None) if kind in "fd" else (None, v, None, None)
    if vr in _LISTS or vr in _TEXTS:
        text = decode_bytes(raw, charset).rstrip("\0").rstrip(" ")
        return (text.split("\\") if vr in _LISTS else [text]), None, None, None
    return None, None, None, raw


#: Element rows go out in batches of so many rows, or bytes of values, at least, whatever the sizes of files: a batch costs as much as hundreds of rows.
BATCH_ROWS, BATCH_BYTES = 8192, 8 << 20
_ARROW = pa.schema([("file", pa.string()), ("path", pa.string()), ("depth", pa.int32()), ("tag", pa.int64()), ("vr", pa.string()), ("s", pa.list_(pa.string())), ("i", pa.list_(pa.decimal128(20, 0))), ("f", pa.list_(pa.float64())), ("b", pa.binary()), ("error", pa.string())])


def _batched(files: Iterator[tuple[list[tuple], int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of the rows of many files; each file comes as its rows and the bytes it was read from."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for rows, n in files:
        held.extend(rows)
        size += n
        if held and (len(held) >= BATCH_ROWS or size >= BATCH_BYTES):
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def parse_files(wanted: frozenset[int] | None):
    """A function from (name, content) of files to batches of their element rows, each of many files; it takes one file at a time."""
    from decimal import Decimal

    def rows_of(name: str, data: bytes) -> list[tuple]:
        out, charset = [], ""
        try:
            for path, depth, tag, vr, raw, little in parse_file(data, wanted):
                if tag == 0x00080005:
                    charset = raw.decode("latin-1").strip("\0 ")
                    if wanted is not None and tag not in wanted:
                        continue
                s, i, f, b = decoded(vr, raw, little, charset)
                out.append((name, path, depth, tag, vr, s, i and [Decimal(x) for x in i], f, b, None))
        except (ValueError, struct.error, zlib.error, LookupError, RecursionError) as e:
            out = [(name, None, None, None, None, None, None, None, None, str(e)[:300])]
        return out

    def run(files: Iterator[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
        return _batched(((rows_of(name, data), len(data)) for name, data in files), _ARROW)

    return run


def _parsed(wanted: frozenset[int] | None):
    """The same over Arrow batches of names and contents."""
    parse = parse_files(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return parse((name, content.as_py() or b"") for batch in batches for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))

    return run


class StrictParser(Parser):
    """For data whose encoding is only supposed: a VR must be one, and tags must ascend, or the supposition was wrong."""

    def header(self, at: int) -> tuple[int, str, int, int]:
        out = super().header(at)
        if self.explicit and out[0] not in (_ITEM, _ITEM_END, _SEQUENCE_END) and self.data[at + 4 : at + 6].decode("latin-1") not in _PAD:
            raise ValueError(f"element {out[0]:08X} has no value representation")
        return out


def parse_payload(data: bytes, syntax: str, wanted: frozenset[int] | None = None) -> tuple[list[tuple], bool, str]:
    """(elements, little-endian, transfer syntax) of a data set without meta group. It is read by the syntax it is said to have; if it isn't that, by
    implicit little-endian, or by explicit where it was said to be implicit. If neither reads it, what was wrong with the first is raised."""
    implicit, explicit = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1"
    first: Exception | None = None
    for supposed in (syntax, explicit if syntax == implicit else implicit):
        try:
            if supposed not in _SYNTAX:
                raise ValueError(f"unknown transfer syntax {supposed}")
            little, is_explicit, deflated = _SYNTAX[supposed]
            body = zlib.decompressobj(-15).decompress(data) if deflated else data
            rows, end = StrictParser(body, little, is_explicit, None if wanted is None else wanted | {0x00080005}).rows(0, len(body))
            top = [r[2] for r in rows if r[1] == 0 and "/" not in r[0]]
            if end != len(body) or any(x >= y for x, y in zip(top, top[1:])):
                raise ValueError("the elements are not in order or end before the data")
            return rows, little, supposed
        except (ValueError, struct.error, zlib.error, LookupError, RecursionError) as e:
            first = first or e
    raise first


def payload_elements(payloads: DataFrame, file: str, content: str, syntax: str, tags: list[int] | None = None) -> DataFrame:
    """Element rows of data sets without meta group, as messages carry them, with `syntax`, the transfer syntax by which each was read.

    `syntax` names what a data set is said to have; where it isn't that, the other of implicit and explicit little-endian is tried. What
    neither reads is one row with `error` and no syntax. A null data set is empty and gives no row; a null syntax is tried as explicit.
    """
    wanted = None if tags is None else frozenset(tags)

    def rows_of(name: str, data: bytes, said: str | None) -> list[tuple]:
        from decimal import Decimal

        try:
            rows, little, chosen = parse_payload(data, (said or "1.2.840.10008.1.2.1").rstrip("\0 "), wanted)
            charset = next((r[4].decode("latin-1").strip("\0 ") for r in rows if r[2] == 0x00080005), "")
            values = [(r, decoded(r[3], r[4], little, charset)) for r in rows if wanted is None or r[2] in wanted or r[3] in ("SQ", "")]
            return [(name, *r[:4], s, i and [Decimal(x) for x in i], f, b, None, chosen) for r, (s, i, f, b) in values]
        except (ValueError, struct.error, zlib.error, LookupError, RecursionError) as e:
            return [(name, *[None] * 8, str(e)[:300], None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((name, data.as_py() or b"", said) for batch in batches for name, data, said in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True))
        return _batched(((rows_of(name, data, said), len(data)) for name, data, said in each), _ARROW.append(pa.field("syntax", pa.string())))

    return payloads.select(F.col(file).cast("string"), F.col(content), F.col(syntax).cast("string")).mapInArrow(run, ELEMENTS + ", syntax string")


def parse_elements(files: DataFrame, file: str, content: str, tags: list[int] | None = None) -> DataFrame:
    """Elements of files held in a binary column. A null file is an error row."""
    wanted = None if tags is None else frozenset(tags)
    return files.select(F.col(file).cast("string"), F.col(content)).mapInArrow(_parsed(wanted), ELEMENTS)


def read_elements(spark: SparkSession, folder: str, tags: list[int] | None = None, glob: str = "*.dcm") -> DataFrame:
    """Elements of all files of a folder; `tags` (group << 16 | element) names those to keep."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return parse_elements(files, "path", "content", tags)


def encoded(tag: int, vr: str, value: bytes, little: bool = True, explicit: bool = True) -> bytes:
    """One element. The value is padded to an even length."""
    order = "<" if little else ">"
    value += _PAD[vr] if len(value) % 2 else b""
    head = struct.pack(order + "HH", tag >> 16, tag & 0xFFFF)
    if not explicit:
        return head + struct.pack(order + "I", len(value)) + value
    if vr in _LONG:
        return head + vr.encode() + b"\0\0" + struct.pack(order + "I", len(value)) + value
    if len(value) > 0xFFFF:
        raise ValueError(f"{tag:08X} is too long for {vr}")
    return head + vr.encode() + struct.pack(order + "H", len(value)) + value


def value_bytes(vr: str, s, i, f, b, little: bool = True) -> bytes:
    """Inverse of `decoded` for the columns of an element row."""
    order = "<" if little else ">"
    if i is not None and vr == "AT":
        return b"".join(struct.pack(order + "HH", int(x) >> 16, int(x) & 0xFFFF) for x in i)
    if i is not None:
        return struct.pack(order + _NUMBERS[vr] * len(i), *map(int, i))
    if f is not None:
        return struct.pack(order + _NUMBERS[vr] * len(f), *f)
    if s is not None:
        return "\\".join(s).encode("utf-8")
    return bytes(b) if b is not None else b""


def _encoded_level(children: dict[str, list], path: str, little: bool, explicit: bool) -> bytes:
    """The elements below a path ("" the data set, else an item), in tag order; sequences and fragments with all they hold."""
    out = []
    for r in sorted((r for r in children.get(path, ()) if r["tag"] >> 16 != 2), key=lambda r: r["tag"]):
        below = sorted(children.get(r["path"], ()), key=lambda x: int(x["path"].rsplit("/", 1)[1]))
        order = "<" if little else ">"
        head = lambda tag, n: struct.pack(order + "HHI", tag >> 16, tag & 0xFFFF, n)
        if r["vr"] == "SQ":
            items = [_encoded_level(children, x["path"], little, explicit) for x in below]
            out.append(encoded(r["tag"], "SQ", b"".join(head(_ITEM, len(x)) + x for x in items), little, explicit))
        elif below:
            parts = [bytes(x["b"] or b"") for x in below]
            parts = [x + b"\0" * (len(x) % 2) for x in parts]
            out.append(struct.pack(order + "HH", 0x7FE0, 0x0010) + (b"OB\0\0" if explicit else b"") + struct.pack(order + "I", UNDEFINED))
            out.append(b"".join(head(_ITEM, len(x)) + x for x in parts) + head(_SEQUENCE_END, 0))
        else:
            out.append(encoded(r["tag"], r["vr"], value_bytes(r["vr"], r["s"], r["i"], r["f"], r["b"], little), little, explicit))
    return b"".join(out)


def file_content(rows: list[dict], syntax: str) -> bytes:
    """A Part 10 file of the element rows of one object, in any order. Text is written as UTF-8."""
    little, explicit, deflated = _SYNTAX[syntax]
    children: dict[str, list] = {}
    for r in rows:
        if r["tag"] != 0x00080005:
            children.setdefault(r["path"].rpartition("/")[0], []).append(r)
    for r in [x for x in rows if x["vr"] != "SQ" and x["path"].endswith("7FE00010/0")]:  # fragments: their element has no row of its own
        own = r["path"][:-2]
        children.setdefault(own.rpartition("/")[0], []).append({**r, "path": own, "b": None})
    if any(r["s"] for r in rows):
        children.setdefault("", []).append({"path": "00080005", "tag": 0x00080005, "vr": "CS", "s": ["ISO_IR 192"], "i": None, "f": None, "b": None})
    data = _encoded_level(children, "", little, explicit)
    by_tag = {r["tag"]: r for r in rows if r["depth"] == 0}
    meta = encoded(0x00020001, "OB", b"\0\1")
    for tag, own in ((0x00020002, 0x00080016), (0x00020003, 0x00080018)):
        if own in by_tag and by_tag[own]["s"]:
            meta += encoded(tag, "UI", by_tag[own]["s"][0].encode())
    meta += encoded(0x00020010, "UI", syntax.encode())
    packer = zlib.compressobj(wbits=-15)
    return b"\0" * 128 + b"DICM" + encoded(0x00020000, "UL", struct.pack("<I", len(meta))) + meta + (packer.compress(data) + packer.flush() if deflated else data)


def _values(column: pa.Array) -> list:
    """What to_pylist gives; the values of lists are taken at once, not list by list."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    inner, at, out = column.flatten().to_pylist(), 0, []
    for n in pc.list_value_length(column).to_pylist():
        out.append(None if n is None else inner[at : at + n])
        at += n or 0
    return out


def write_content(elements: DataFrame, syntax: str = "1.2.840.10008.1.2.1") -> DataFrame:
    """(file, content): a Part 10 file of the elements of each file, nested items and fragments too, in tag order.

    The rows of a file are gathered, as they must: a file is the unit; many files are written in one Arrow batch. Rows with an
    error are left out. An element that is there twice is written twice.
    """
    schema = pa.schema([("file", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1)
            fields = [f.name for f in rows.type.value_type]
            flat = [dict(zip(fields, values, strict=True)) for values in zip(*[_values(c) for c in rows.flatten().flatten()], strict=True)]
            at = [0, *pc.cumulative_sum(pc.list_value_length(rows)).to_pylist()]
            content = [file_content(flat[start:end], syntax) for start, end in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(content, pa.binary())], schema=schema)

    rows = F.collect_list(F.struct("path", "depth", "tag", "vr", "s", "i", "f", "b"))
    return elements.where("error IS NULL").groupBy("file").agg(rows.alias("rows")).mapInArrow(run, "file string, content binary")


def instances(elements: DataFrame, keywords: list[str]) -> DataFrame:
    """One row for each file with a column for each keyword: the first value of the top-level element, as text."""
    tag_of = {k: g << 16 | e for g, e, _, k in TAG}
    first = F.coalesce(F.get("s", F.lit(0)), F.get("i", F.lit(0)).cast("string"), F.get("f", F.lit(0)).cast("string"))
    own = elements.where(F.col("tag").isin([tag_of[k] for k in keywords]) & (F.col("depth") == 0))
    return own.groupBy("file").agg(*[F.max(F.when(F.col("tag") == tag_of[k], first)).alias(k) for k in keywords])
