"""Protocol data units as Column expressions over binary: headers, P-DATA, association requests and command sets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the standard (PS3.8 section 9.3): PDU and item types.
ASSOCIATE_RQ, ASSOCIATE_AC, ASSOCIATE_RJ, P_DATA_TF, RELEASE_RQ, RELEASE_RP, ABORT = 1, 2, 3, 4, 5, 6, 7
APPLICATION_CONTEXT, CONTEXT_RQ, ABSTRACT_SYNTAX, TRANSFER_SYNTAX, USER_INFORMATION, MAX_LENGTH = 0x10, 0x20, 0x30, 0x40, 0x50, 0x51
APPLICATION_CONTEXT_UID = "1.2.840.10008.3.1.1.1"
COMMAND, LAST = 1, 2
PDVS = "array<struct<context: int, control: int, data: binary>>"
ITEMS = "array<struct<type: int, data: binary>>"


def big_endian(number: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(number.cast("long")), 2 * size, "0"))


def little_endian(number: Column, size: int) -> Column:
    h = F.lpad(F.hex(number.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(size))]))


def number(data: Column, at, size: int) -> Column:
    """The big-endian number of `size` bytes from byte `at` (0 is the first)."""
    return F.conv(F.hex(F.substring(data, F.lit(at) + 1 if isinstance(at, int) else (at + 1).cast("int"), F.lit(size))), 16, 10).cast("long")


def join_bytes(parts: Column) -> Column:
    """The parts one after the other, in time that grows with their length alone; null parts count as empty."""
    return F.unhex(F.array_join(F.transform(parts, lambda p: F.coalesce(F.hex(p), F.lit(""))), ""))


def framed(kind: int, body: Column) -> Column:
    """Type, a zero byte, the length of the body, the body."""
    return F.concat(F.lit(bytes([kind, 0])), big_endian(F.length(body), 4), body)


def item(kind: int, data: Column) -> Column:
    return F.concat(F.lit(bytes([kind, 0])), big_endian(F.length(data), 2), data)


def kind(pdu: Column) -> Column:
    return number(pdu, 0, 1).cast("int")


def body(pdu: Column) -> Column:
    """The body of a whole PDU; null if its length isn't what the header says."""
    return F.when(F.length(pdu) == number(pdu, 2, 4) + 6, F.substring(pdu, F.lit(7), F.length(pdu) - 6))


def p_data(pdvs: Column) -> Column:
    """A P-DATA-TF of an array of (context, control, data)."""
    return framed(P_DATA_TF, join_bytes(F.transform(pdvs, lambda p: F.concat(big_endian(F.length(p["data"]) + 2, 4), big_endian(p["context"], 1), big_endian(p["control"], 1), p["data"]))))


def _walk(data: Column, header: int, length, make, kind_of: str) -> Column:
    """Values one after the other; ends at what doesn't fit. `length` (of the data and a place) and `make` (of the data, a place and a length) say how long
    a value is and what it is.

    The number of steps is bounded by the length of the data. They are taken in runs of its square root, and no run begins behind the end, so few
    long values don't cost the steps of many short ones. The data are bound once: an expression would be computed anew in each step."""

    def of(d: Column) -> Column:
        most = F.greatest(F.lit(0), F.floor(F.length(d) / header).cast("int"))
        run = F.ceil(F.sqrt(most + 1)).cast("int")
        fits = lambda at: F.coalesce((at + header <= F.length(d)) & (length(d, at) >= 0) & (at + header + length(d, at) <= F.length(d)), F.lit(False))

        def step(state: Column, _: Column) -> Column:
            at = state["at"]
            n = length(d, at)
            moved = F.struct((at + header + n).alias("at"), F.concat(state["out"], F.array(make(d, at, n)).cast(kind_of)).alias("out"))
            return F.when(fits(at), moved).otherwise(state)

        def steps(state: Column, _: Column) -> Column:
            return F.when(fits(state["at"]), F.aggregate(F.sequence(F.lit(1), run), state, step)).otherwise(state)

        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind_of).alias("out"))
        return F.aggregate(F.sequence(F.lit(1), run), start, steps, lambda s: s["out"])

    return F.get(F.transform(F.array(data), of), F.lit(0))


def pdvs(p_data_body: Column) -> Column:
    """The (context, control, data) of a P-DATA-TF body."""
    part = lambda d, at, n: F.substring(d, (at + 1).cast("int"), n.cast("int"))
    return _walk(p_data_body, 6, lambda d, at: number(d, at, 4) - 2, lambda d, at, n: F.struct(number(d, at + 4, 1).cast("int").alias("context"), number(d, at + 5, 1).cast("int").alias("control"), part(d, at + 6, n).alias("data")), PDVS)


def items(data: Column) -> Column:
    """The (type, data) of a run of items with two-byte lengths."""
    part = lambda d, at, n: F.substring(d, (at + 1).cast("int"), n.cast("int"))
    return _walk(data, 4, lambda d, at: number(d, at + 2, 2), lambda d, at, n: F.struct(number(d, at, 1).cast("int").alias("type"), part(d, at + 4, n).alias("data")), ITEMS)


def is_last(control: Column) -> Column:
    return control.bitwiseAND(LAST) != 0


def is_command(control: Column) -> Column:
    return control.bitwiseAND(COMMAND) != 0


def _title(c: Column) -> Column:
    return F.substring(F.rpad(c, 16, " "), 1, 16).cast("binary")


def associate_rq(called: Column, calling: Column, contexts: Column, max_pdu: Column) -> Column:
    """A-ASSOCIATE-RQ. contexts: array of (id, abstract, array of transfer syntaxes)."""
    uid = lambda kind_, c: item(kind_, c.cast("binary"))
    context = lambda c: item(CONTEXT_RQ, F.concat(big_endian(c["id"], 1), F.lit(b"\0\0\0"), uid(ABSTRACT_SYNTAX, c["abstract"]), join_bytes(F.transform(c["transfer"], lambda t: uid(TRANSFER_SYNTAX, t)))))
    user = item(USER_INFORMATION, item(MAX_LENGTH, big_endian(max_pdu, 4)))
    return framed(ASSOCIATE_RQ, F.concat(F.lit(b"\0\1\0\0"), _title(called), _title(calling), F.lit(b"\0" * 32), uid(APPLICATION_CONTEXT, F.lit(APPLICATION_CONTEXT_UID)), join_bytes(F.transform(contexts, context)), user))


def associate_titles(rq_body: Column) -> tuple[Column, Column]:
    """(called, calling) of an association request's body."""
    text = lambda at: F.trim(F.decode(F.substring(rq_body, at, 16), "ISO-8859-1"))
    return text(5), text(21)


def associate_items(rq_body: Column) -> Column:
    return items(F.substring(rq_body, F.lit(69), F.length(rq_body) - 68))


def context_rq(data: Column) -> tuple[Column, Column, Column]:
    """(id, abstract syntax, transfer syntaxes) of a presentation context item."""
    inner = items(F.substring(data, F.lit(5), F.length(data) - 4))
    of = lambda k: F.transform(F.filter(inner, lambda i: i["type"] == k), lambda i: F.rtrim(F.decode(i["data"], "ISO-8859-1")))
    return number(data, 0, 1).cast("int"), F.get(of(ABSTRACT_SYNTAX), F.lit(0)), of(TRANSFER_SYNTAX)


def command_element(tag: int, value: Column) -> Column:
    """An element of a command set: implicit little endian, padded to an even length."""
    padded = F.when(F.length(value) % 2 == 1, F.concat(value, F.lit(b"\0"))).otherwise(value)
    return F.concat(little_endian(F.lit(tag >> 16), 2), little_endian(F.lit(tag & 0xFFFF), 2), little_endian(F.length(padded), 4), padded)


def command_set(elements: list[Column]) -> Column:
    """Elements in tag order behind their group length."""
    data = F.concat(*elements)
    return F.concat(command_element(0, little_endian(F.length(data), 4)), data)


CONTEXT_AC = 0x21


def associate_ac(called: Column, calling: Column, results: Column, max_pdu: Column) -> Column:
    """A-ASSOCIATE-AC. results: array of (id, result, transfer syntax); the syntax of a context that isn't accepted says nothing."""
    context = lambda c: item(CONTEXT_AC, F.concat(big_endian(c["id"], 1), F.lit(b"\0"), big_endian(c["result"], 1), F.lit(b"\0"), item(TRANSFER_SYNTAX, c["transfer"].cast("binary"))))
    user = item(USER_INFORMATION, item(MAX_LENGTH, big_endian(max_pdu, 4)))
    return framed(ASSOCIATE_AC, F.concat(F.lit(b"\0\1\0\0"), _title(called), _title(calling), F.lit(b"\0" * 32), item(APPLICATION_CONTEXT, F.lit(APPLICATION_CONTEXT_UID).cast("binary")), join_bytes(F.transform(results, context)), user))


def context_ac(data: Column) -> tuple[Column, Column, Column]:
    """(id, result, transfer syntax) of a presentation context item of an acceptance."""
    inner = items(F.substring(data, F.lit(5), F.length(data) - 4))
    return number(data, 0, 1).cast("int"), number(data, 2, 1).cast("int"), F.rtrim(F.decode(F.get(inner, F.lit(0))["data"], "ISO-8859-1"))


def max_length(user_information: Column) -> Column:
    """The greatest PDU that the data of a user information item name; null where they name none."""
    return number(F.get(F.filter(items(user_information), lambda i: i["type"] == MAX_LENGTH), F.lit(0))["data"], 0, 4)


def associate_rj(result: Column, source: Column, reason: Column) -> Column:
    return framed(ASSOCIATE_RJ, F.concat(F.lit(b"\0"), *[big_endian(c, 1) for c in (result, source, reason)]))


def release(reply: bool = False) -> Column:
    """A-RELEASE-RQ, or -RP as the reply."""
    return framed(RELEASE_RP if reply else RELEASE_RQ, F.lit(b"\0" * 4))


def abort(source: Column, reason: Column) -> Column:
    return framed(ABORT, F.concat(F.lit(b"\0\0"), big_endian(source, 1), big_endian(reason, 1)))


def reasons(pdu_body: Column) -> Column:
    """struct(result, source, reason) of the body of a rejection or an abort; an abort's result is 0."""
    return F.struct(*[number(pdu_body, k, 1).cast("int").alias(n) for k, n in ((1, "result"), (2, "source"), (3, "reason"))])
