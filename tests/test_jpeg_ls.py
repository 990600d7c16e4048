"""Context states of JPEG-LS scans beside a sequential coder that keeps the whole scan's state."""

import random

import pytest

from tessera.operators import jpeg_ls

J = jpeg_ls.RUN_ORDERS


def scanned(px, rows, cols, top, reset):
    """One pass over a frame: states of the contexts, of the run mode, and all bits."""
    t = jpeg_ls.traits(top, reset)
    span, limit, qbpp = t["range"], t["limit"], t["qbpp"]
    at = lambda r, c: 0 if r < 0 else px[r * cols + c]

    def level(d):
        size = sum(abs(d) >= x for x in (1, t["t1"], t["t2"], t["t3"]))
        return size if d >= 0 else -size

    def wrapped(e):
        e %= span
        return e - span if e >= (span + 1) // 2 else e

    def code(m, k, most):
        return (m >> k) + 1 + k if (m >> k) < most - qbpp - 1 else most

    def least(n, a):
        k = 0
        while n << k < a:
            k += 1
        return k

    contexts, stops, index, runs, run_bits = {}, [[t["a"], 1, 0], [t["a"], 1, 0]], 0, 0, 0
    for r in range(rows):
        c = 0
        while c < cols:
            x, b = at(r, c), at(r - 1, c)
            a = b if c == 0 else at(r, c - 1)
            up = at(r - 2, 0) if c == 0 else at(r - 1, c - 1)
            d = b if c == cols - 1 else at(r - 1, c + 1)
            s = (level(d - b) * 9 + level(b - up)) * 9 + level(up - a)
            if s:
                g, q = (-1 if s < 0 else 1), abs(s)
                v = contexts.setdefault(q, [t["a"], 0, 0, 1, 0, 0])
                p = min(a, b) if up >= max(a, b) else max(a, b) if up <= min(a, b) else a + b - up
                e = wrapped(g * (x - max(0, min(top, p + g * v[2]))))
                k = least(v[3], v[0])
                m = 2 * e if e >= 0 else -2 * e - 1
                v[5] += code(m ^ 1 if k == 0 and 2 * v[1] <= -v[3] else m, k, limit)
                v[0], v[1], v[4] = v[0] + abs(e), v[1] + e, v[4] + 1
                if v[3] == reset:
                    v[0], v[1], v[3] = v[0] >> 1, v[1] >> 1, v[3] >> 1
                v[3] += 1
                if v[1] <= -v[3]:
                    v[1], v[2] = max(v[1] + v[3], 1 - v[3]), max(v[2] - 1, -128)
                elif v[1] > 0:
                    v[1], v[2] = min(v[1] - v[3], 0), min(v[2] + 1, 127)
                c += 1
                continue
            runs, n = runs + 1, 0
            while c < cols and at(r, c) == a:
                n, c = n + 1, c + 1
            while n >= 1 << J[index]:
                n, run_bits = n - (1 << J[index]), run_bits + 1
                index = min(31, index + 1)
            if c == cols:
                run_bits += n > 0
                continue
            x, b = at(r, c), at(r - 1, c)
            kind = int(a == b)
            v = stops[kind]
            e = wrapped((x - b) * (-1 if a > b else 1))
            k = least(v[1], v[0] + kind * (v[1] >> 1))
            swap = (k == 0 and e > 0 and 2 * v[2] < v[1]) or (e < 0 and (2 * v[2] >= v[1] or k != 0))
            m = 2 * abs(e) - kind - swap
            run_bits += 1 + J[index] + code(m, k, limit - J[index] - 1)
            v[0], v[2] = v[0] + ((m + 1 - kind) >> 1), v[2] + (e < 0)
            if v[1] == reset:
                v[:] = [y >> 1 for y in v]
            v[1] += 1
            index, c = max(0, index - 1), c + 1
    return {(q, *v) for q, v in contexts.items()}, (runs, index, *stops[0], *stops[1], run_bits)


@pytest.mark.parametrize("rows,cols,top,reset", [(1, 1, 15, 3), (1, 70, 15, 3), (9, 40, 1, 5), (12, 7, 63, 4), (30, 30, 255, 64), (6, 6, 4095, 64)])
def test_states_equal_those_of_a_sequential_scan(spark, rows, cols, top, reset):
    rng = random.Random(rows * cols)
    flat = [rng.choice([0, 0, 0, 1, top]) for _ in range(rows * cols)]
    noise = [rng.randint(0, top) for _ in range(rows * cols)]
    px = {1: flat, 2: noise, 3: [0] * (rows * cols), 4: [top] * (rows * cols)}
    scan = jpeg_ls.scan_samples(spark.createDataFrame([*px.items(), (5, None)], "f int, px array<int>"), ["f"], "px", rows, cols, top).cache()
    states = {f: set() for f in px}
    for row in jpeg_ls.context_states(scan, ["f"], top, reset).collect():
        states[row["f"]].add((row["q"], row["a"], row["b"], row["c"], row["n"], row["samples"], row["bits"]))
    runs = {row["f"]: tuple(row)[1:] for row in jpeg_ls.run_states(scan, ["f"], top, reset).collect()}
    for f, p in px.items():
        contexts, run = scanned(p, rows, cols, top, reset)
        assert states[f] == contexts
        assert runs.get(f, (0, 0, jpeg_ls.traits(top)["a"], 1, 0, jpeg_ls.traits(top)["a"], 1, 0, 0)) == run
    scan.unpersist()


def test_arrays_that_are_no_frames(spark):
    for px in ([1, 2], [1, 2, 3, 16], [1, 2, 3, None], [1, 2, 3, -1]):
        with pytest.raises(Exception, match="samples of 0 to 15"):
            jpeg_ls.scan_samples(spark.createDataFrame([(1, px)], "f int, px array<int>"), ["f"], "px", 2, 2, 15).collect()
    assert jpeg_ls.scan_samples(spark.createDataFrame([], "f int, px array<int>"), ["f"], "px", 2, 2, 15).count() == 0
    with pytest.raises(ValueError):
        jpeg_ls.traits(0)
