"""Adaptive context modelling of a lossless JPEG-LS scan (ISO/IEC 14495-1, annex A): modes, context states, run index and coded bits.

Without loss a sample's neighbours are samples, so gradients, contexts and runs are known beforehand, and each context is a fold of its own: only
the samples of one context of one frame meet in a task. Run interruptions share the run index and are one fold a frame, over its runs alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions import codec_math
from tessera.functions.codec_math import let

#: Fixed values of the standard: order of the run lengths (code table J), bounds of the bias correction.
RUN_ORDERS = [0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 9, 10, 11, 12, 13, 14, 15]
MIN_BIAS, MAX_BIAS = -128, 127


def traits(max_val: int, reset: int = 64) -> dict[str, int]:
    """Traits of a lossless scan of samples 0 to `max_val`; `a` is the first sum of errors of a context."""
    if max_val < 1 or reset < 3:
        raise ValueError("JPEG-LS takes samples up to 1 or more, and contexts that are halved after 3 samples or more")
    t = codec_math.jpeg_ls_defaults(max_val)
    return t | {"max_val": max_val, "reset": reset, "a": max(2, (t["range"] + 32) // 64)}


def scan_samples(frames: DataFrame, keys: list[str], samples: str, rows: int, cols: int, max_val: int) -> DataFrame:
    """One row for each sample of each frame: keys, `i`, `x`, its neighbours `a` `b` `c` `d`, its context `q` (0 to 364), `sign`, and its `mode`.

    `samples` holds rows * cols integers, row by row, and `keys` tell frames apart. The mode is `regular`, `run` (equal to its left neighbour
    inside a run) or `interruption` (the sample that ends a run); `run` is the place where the sample's run began, else null. A null array has
    no rows; an array of another length, or with nulls or samples outside 0 to `max_val`, is no frame and raises an error.
    """
    t = traits(max_val)
    own = frames.select(*keys, F.col(samples).alias("_px")).where(F.col("_px").isNotNull())
    fits = (F.size("_px") == rows * cols) & F.forall("_px", lambda x: x.isNotNull() & (x >= 0) & (x <= max_val))
    own = own.withColumn("_px", F.when(fits, F.col("_px")).otherwise(F.raise_error(F.lit(f"a frame has {rows * cols} samples of 0 to {max_val}"))))
    own = own.select(*keys, "_px", F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))).alias("i"))
    r, c = F.floor(F.col("i") / cols).cast("int"), F.col("i") % cols

    def at(row: Column, col: Column) -> Column:
        return F.when(row < 0, 0).otherwise(F.get("_px", (row * cols + col).cast("int"))).cast("int")

    above = at(r - 1, c)
    own = own.select(
        *keys, "i", r.alias("_row"), F.get("_px", "i").cast("int").alias("x"), F.when(c == 0, above).otherwise(at(r, c - 1)).alias("a"), above.alias("b"),
        F.when(c == 0, at(r - 2, c)).otherwise(at(r - 1, c - 1)).alias("c"), F.when(c == cols - 1, above).otherwise(at(r - 1, c + 1)).alias("d"))
    q = [codec_math.quantized_gradient(g, t["t1"], t["t2"], t["t3"]) for g in (F.col("d") - F.col("b"), F.col("b") - F.col("c"), F.col("c") - F.col("a"))]
    own = own.withColumn("_q", codec_math.context_id(*q))
    own = own.withColumns({"q": F.abs("_q"), "sign": F.when(F.col("_q") < 0, -1).otherwise(1)})
    # a sample is in a run if one began in its line, at gradients of 0, and no sample since then differed from its left neighbour
    line = Window.partitionBy(*keys, "_row").orderBy("i")
    so_far, before = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_broke", F.coalesce(F.last(F.when(F.col("x") != F.col("a"), F.col("i")), True).over(before), F.lit(-1)))
    own = own.withColumn("_flat", F.last(F.when(F.col("q") == 0, F.col("i")), True).over(so_far))
    own = own.withColumn("_in", F.coalesce(F.col("_flat") > F.col("_broke"), F.lit(False)))
    goes_on = F.coalesce(F.lag(F.col("_in") & (F.col("x") == F.col("a"))).over(line), F.lit(False))
    own = own.withColumn("_begins", F.when(F.col("_in") & ~goes_on, F.col("i")))
    mode = F.when(~F.col("_in"), "regular").when(F.col("x") == F.col("a"), "run").otherwise("interruption")
    own = own.withColumns({"mode": mode, "run": F.when(F.col("_in"), F.last("_begins", True).over(so_far))})
    return own.select(*keys, "i", "x", "a", "b", "c", "d", "q", "sign", "mode", "run")


def context_states(scan: DataFrame, keys: list[str], max_val: int, reset: int = 64) -> DataFrame:
    """What each regular context of each frame of `scan_samples` holds after the scan: keys, `q`, `a`, `b`, `c`, `n`, `samples`, `bits`.

    `a` is the sum of the errors' sizes, `b` of the errors, `c` the bias and `n` the count, halved whenever it reaches `reset`; `bits` is the
    length of the codes of the context's samples. Contexts that a frame never meets have no row: they hold their first values.
    """
    t = traits(max_val, reset)
    predicted = codec_math.med_predictor(F.col("a"), F.col("b"), F.col("c"))
    own = scan.where(F.col("mode") == "regular").select(*keys, "q", F.struct("i", "x", predicted.alias("p"), F.col("sign").alias("g")).alias("_s"))
    own = own.groupBy(*keys, "q").agg(F.array_sort(F.collect_list("_s")).alias("_s"))
    start = F.struct(F.lit(t["a"]).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), F.lit(1).alias("n"), F.lit(0).cast("long").alias("bits"))
    end = F.aggregate("_s", start, lambda s, x: _regular(s, x, t))
    return own.select(*keys, "q", F.size("_s").alias("samples"), end.alias("_end")).select(*keys, "q", "_end.a", "_end.b", "_end.c", "_end.n", "samples", "_end.bits")


def run_states(scan: DataFrame, keys: list[str], max_val: int, reset: int = 64) -> DataFrame:
    """The run mode of each frame of `scan_samples` after the scan: keys, `runs`, `run_index`, `a0` `n0` `m0` (interruptions whose left and upper
    neighbour differ), `a1` `n1` `m1` (whose are equal), `bits`. `m` counts errors below 0. Frames without runs have no row."""
    t = traits(max_val, reset)
    ends = lambda c: F.max(F.when(F.col("mode") == "interruption", F.col(c)))
    runs = scan.where(F.col("run").isNotNull()).groupBy(*keys, "run").agg(F.count_if(F.col("mode") == "run").cast("int").alias("length"), ends("x").alias("x"), ends("a").alias("a"), ends("b").alias("b"))
    runs = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("run", "length", "x", "a", "b"))).alias("_r"))
    first = {"k": F.lit(0), "a0": F.lit(t["a"]), "n0": F.lit(1), "m0": F.lit(0), "a1": F.lit(t["a"]), "n1": F.lit(1), "m1": F.lit(0), "bits": F.lit(0).cast("long")}
    end = F.aggregate("_r", F.struct(*[v.alias(n) for n, v in first.items()]), lambda s, r: _run(s, r, t))
    names = ["a0", "n0", "m0", "a1", "n1", "m1", "bits"]
    return runs.select(*keys, F.size("_r").alias("runs"), end.alias("_end")).select(*keys, "runs", F.col("_end.k").alias("run_index"), *[f"_end.{n}" for n in names])


def _code_bits(mapped: Column, k: Column, limit: Column, qbpp: int) -> Column:
    high = F.call_function("shiftright", mapped, k)
    return F.when(high < limit - qbpp - 1, high + 1 + k).otherwise(limit)


def _half(v: Column) -> Column:
    return F.floor(v / 2).cast("int")


def _regular(s: Column, x: Column, t: dict[str, int]) -> Column:
    """The state of a context after one more sample."""
    corrected = F.greatest(F.lit(0), F.least(F.lit(t["max_val"]), x["p"] + x["g"] * s["c"]))
    k = codec_math.golomb_parameter(s["n"], s["a"])

    def met(v: Column) -> Column:
        e, k = v["e"], v["k"]
        swapped = (k == 0) & (2 * s["b"] <= -s["n"])
        mapped = F.when(swapped, F.when(e >= 0, 2 * e + 1).otherwise(-2 * e - 2)).otherwise(codec_math.mapped_error(e))
        full = s["n"] == t["reset"]
        a, b = s["a"] + F.abs(e), s["b"] + e
        held = F.struct(
            F.when(full, _half(a)).otherwise(a).alias("a"), F.when(full, _half(b)).otherwise(b).alias("b"), (F.when(full, _half(s["n"])).otherwise(s["n"]) + 1).alias("n"),
            (s["bits"] + _code_bits(mapped, k, F.lit(t["limit"]), t["qbpp"])).alias("bits"))
        return let(held, lambda h: _biased(h, s["c"]))

    return let(F.struct(codec_math.modulo_error(x["g"] * (x["x"] - corrected), t["range"]).cast("int").alias("e"), k.alias("k")), met)


def _biased(h: Column, c: Column) -> Column:
    """Errors below or above 0 on average move the bias by one."""
    b, n = h["b"], h["n"]
    low, high = b <= -n, b > 0
    return F.struct(
        h["a"].alias("a"), F.when(low, F.greatest(b + n, 1 - n)).when(high, F.least(b - n, F.lit(0))).otherwise(b).cast("int").alias("b"),
        F.when(low, F.greatest(c - 1, F.lit(MIN_BIAS))).when(high, F.least(c + 1, F.lit(MAX_BIAS))).otherwise(c).cast("int").alias("c"), n.alias("n"), h["bits"].cast("long").alias("bits"))


def _run(s: Column, r: Column, t: dict[str, int]) -> Column:
    """The state of the run mode after one more run: its whole segments raise the index, an interruption lowers it."""
    ahead = [0]
    for order in RUN_ORDERS[:-1]:
        ahead.append(ahead[-1] + (1 << order))
    steps, orders = F.array(*map(F.lit, ahead)), F.array(*map(F.lit, RUN_ORDERS))
    reach = r["length"] + F.get(steps, s["k"])
    top = (F.size(F.filter(steps, lambda v: v <= reach)) - 1).cast("int")

    def coded(v: Column) -> Column:
        k, left, ones = v["k"], v["left"], v["k"] - s["k"] + v["more"]
        order = F.get(orders, k)
        equal = r["a"] == r["b"]
        at_end = F.struct(k.alias("k"), *[s[n].alias(n) for n in ("a0", "n0", "m0", "a1", "n1", "m1")], (s["bits"] + ones + F.when(left > 0, 1).otherwise(0)).alias("bits"))
        e = codec_math.modulo_error(F.when(~equal & (r["a"] > r["b"]), -1).otherwise(1) * (r["x"] - r["b"]), t["range"]).cast("int")
        held = F.struct(
            k.alias("k"), e.alias("e"), equal.alias("equal"), F.when(equal, s["a1"]).otherwise(s["a0"]).alias("a"), F.when(equal, s["n1"]).otherwise(s["n0"]).alias("n"),
            F.when(equal, s["m1"]).otherwise(s["m0"]).alias("m"), order.alias("order"), (s["bits"] + ones + 1 + order).alias("bits"))
        return F.when(r["x"].isNull(), at_end).otherwise(let(held, lambda h: _interrupted(s, h, t)))

    last = len(RUN_ORDERS) - 1
    left = F.struct((reach - F.get(steps, top)).alias("left"), top.alias("k"))
    whole = lambda v: F.when(v["k"] == last, F.shiftright(v["left"], RUN_ORDERS[-1])).otherwise(0)
    return let(left, lambda v: let(F.struct(v["k"].alias("k"), whole(v).alias("more"), (v["left"] - F.shiftleft(whole(v), RUN_ORDERS[-1])).alias("left")), coded))


def _interrupted(s: Column, h: Column, t: dict[str, int]) -> Column:
    e, a, n, m, kind = h["e"], h["a"], h["n"], h["m"], F.when(h["equal"], 1).otherwise(0)

    def met(k: Column) -> Column:
        swapped = ((k == 0) & (e > 0) & (2 * m < n)) | ((e < 0) & ((2 * m >= n) | (k != 0)))
        mapped = 2 * F.abs(e) - kind - F.when(swapped, 1).otherwise(0)
        a_now, m_now, full = a + _half(mapped + 1 - kind), m + F.when(e < 0, 1).otherwise(0), n == t["reset"]
        now = {"a": F.when(full, _half(a_now)).otherwise(a_now), "n": F.when(full, _half(n)).otherwise(n) + 1, "m": F.when(full, _half(m_now)).otherwise(m_now)}
        fields = [F.when(h["equal"] if i else ~h["equal"], now[c]).otherwise(s[f"{c}{i}"]).cast("int").alias(f"{c}{i}") for i in (0, 1) for c in ("a", "n", "m")]
        bits = h["bits"] + _code_bits(mapped, k, t["limit"] - h["order"] - 1, t["qbpp"])
        return F.struct(F.greatest(F.lit(0), h["k"] - 1).cast("int").alias("k"), *fields, bits.cast("long").alias("bits"))

    return let(codec_math.golomb_parameter(n, a + F.when(h["equal"], _half(n)).otherwise(0)), met)
