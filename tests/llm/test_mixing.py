import re

from tessera.llm.mixing import apply_mix, mix, sainte_lague


def test_sainte_lague_is_highest_quotients(spark):
    cases = [([53, 24, 23], 100), ([1, 1, 1], 7), ([1000, 1, 1, 1, 0], 11), ([10.5, 3.25, 7.75, 1.5], 1000), ([5], 3), ([3, 1], 0)]
    rows = [(g, p, float(w), seats) for g, (ws, seats) in enumerate(cases) for p, w in enumerate(ws)]
    got = {(r.g, r.p): r.quota for r in sainte_lague(spark.createDataFrame(rows, "g int, p int, w double, seats long"), ["g"], ["p"], "w", "seats").collect()}
    for g, (ws, seats) in enumerate(cases):
        won = [0] * len(ws)
        for _ in range(seats):
            best = max(range(len(ws)), key=lambda p: (ws[p] / (2 * won[p] + 1), -p))
            won[best] += 1
        assert [got[g, p] for p in range(len(ws))] == won


def targets(sizes):
    """Water filling as the contract words it."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w, total, fixed = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left, weight = total - sum(fixed.values()), sum(w[s] for s in rest)
        own = {s: left * w[s] / weight for s in rest}
        over = [s for s in rest if own[s] > 3 * sizes[s]]
        if not over:
            return fixed | own
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mix(spark):
    rows = [(k, " ".join(["w"] * (k * 37 % 200)), f"s{k * k % 5}" if k % 11 else None, k) for k in range(1500)]
    rows += [(None, "a b c", "s1", 1), (5, "again", "s1", 1), (5, "again", "s1", 1), (9000, None, "s2", 0), (9001, "x " * 30_000, "tiny", 0), (9002, "y", "zz", 0), (9003, "", "zero", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    for buckets in (20_000, 100):
        out = mix(docs, rows_per_bucket=buckets).toPandas()
        out["source"] = out.source.where(out.source.notna(), None)
        assert len(out) == len(rows)
        assert (out["size"].sort_values().tolist()) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows)
        sizes, taken = {}, {}
        for s, n, t in zip(out.source, out["size"], out.taken):
            sizes[s], taken[s] = sizes.get(s, 0) + n, taken.get(s, 0) + t
        want = targets(sizes)
        for s in sizes:
            own = out[out.source.isna()] if s is None else out[out.source == s]
            assert set(own.source_size) == {sizes[s]} and abs(own.target.iloc[0] - want[s]) < 1e-6 * max(1, want[s])
            assert abs(taken[s] - want[s]) <= 12 + 0.001 * want[s], s
        assert ((out.taken >= 0) & (out.taken <= 3 * out["size"])).all()
        again = mix(docs.repartition(7), rows_per_bucket=buckets).toPandas()
        assert sorted(zip(out.doc_id.fillna(-1), out["size"], out.taken)) == sorted(zip(again.doc_id.fillna(-1), again["size"], again.taken))


def test_apply_takes_as_many_words(spark):
    docs = spark.createDataFrame([(1, " a  b\nc d", "x"), (2, "e f", "y"), (3, None, "y")], "doc_id long, text string, source string")
    mixed = spark.createDataFrame([(1, 4, 6), (2, 2, 6), (3, 0, 0)], "doc_id long, size long, taken long")
    got = sorted((r.doc_id, r.text) for r in apply_mix(docs, mixed).collect())
    assert got == [(1, " a  b"), (1, " a  b\nc d"), (2, "e f"), (2, "e f"), (2, "e f")]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(docs).count() == 0
    assert [r.taken for r in mix(spark.createDataFrame([(1, None, None)], docs.schema)).collect()] == [0]


def test_chosen_words_are_given_out(spark):
    """Of every source exactly the chosen blocks come out, from anywhere in a document; rows of equal id keep their own."""
    rows = [(k % 40 if k % 9 else None, " ".join(f"{k}:{i}" for i in range(k * 37 % 300)), f"s{k % 4}") for k in range(240)]
    rows += [(7000, " ".join(f"big:{i}" for i in range(20_000)), "s0")] + [(5, "twice of it", "s1")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    mixed = mix(docs, blocks_per_source=64, ranges=True).cache()
    plain = sorted((r.doc_id or -1, r["size"], r.taken) for r in mix(docs, blocks_per_source=64).collect())
    chosen = mixed.collect()
    assert plain == sorted((r.doc_id or -1, r["size"], r.taken) for r in chosen)
    for r in chosen:
        n = sum(x.end - x.begin for x in r.ranges)
        assert (r.taken - n) % max(1, r["size"]) == 0 and n <= r["size"] and all(0 <= x.begin < x.end <= r["size"] for x in r.ranges)
        assert all(x.end < y.begin for x, y in zip(r.ranges, r.ranges[1:]))
    out = apply_mix(docs, mixed).collect()
    assert sum(len(r.text.split()) for r in out) == sum(r.taken for r in chosen)
    assert any(0 < x.begin for r in chosen for x in r.ranges if r.doc_id == 7000)
    want = {}
    for r in chosen:
        if r.doc_id == 7000:
            words = rows[240][1].split()
            copies = [words] * (r.taken // r["size"]) + ([words[x.begin : x.end] for x in r.ranges] if r.taken % r["size"] else [])
            assert sorted(copies) == sorted(o.text.split() for o in out if o.doc_id == 7000)
        want.setdefault((r.doc_id, r.source), []).append(r.taken)
    for (d, s), takes in want.items():
        assert sum(takes) == sum(len(o.text.split()) for o in out if (o.doc_id, o.source) == (d, s))


def test_most_rows_under_one_id(spark):
    """Nine rows in ten share an id or have none, many are equal: targets hold, reruns agree, what is taken comes out."""
    rows = [(7 if k % 2 else None, " ".join(f"{k % 300}:{i}" for i in range(k % 300 % 40)), "hot") for k in range(3600)]
    rows += [(k, " ".join(f"u{k}:{i}" for i in range(k % 50)), f"s{k % 3}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for ranges in (False, True):
        mixed = mix(docs, blocks_per_source=64, rows_per_bucket=20, ranges=ranges)
        out = mixed.toPandas()
        assert len(out) == len(rows) and ((out.taken >= 0) & (out.taken <= 3 * out["size"])).all()
        block = -(-out["size"].sum() // (4 * 64))
        for _, own in out.groupby("source"):
            assert own["size"].sum() == own.source_size.iloc[0] and abs(own.taken.sum() - own.target.iloc[0]) <= 2 * block
        again = mix(docs.repartition(7), blocks_per_source=64, rows_per_bucket=20, ranges=ranges).toPandas()
        count = lambda x: sorted(zip(x.doc_id.fillna(-1), x["size"], x.taken))
        assert count(out) == count(again)
    texts = [r.text for r in apply_mix(docs, mixed).collect()]
    assert sum(len(t.split()) for t in texts) == out.taken.sum()


def test_equal_ids_are_taken_as_mixed(spark):
    docs = spark.createDataFrame([(1, "a " * 50, "x"), (1, "b " * 5, "x"), (None, "c c", "x"), (None, "c c", "x"), (None, None, "x")], "doc_id long, text string, source string")
    mixed = mix(docs, blocks_per_source=16, ranges=True).cache()
    assert sum(len(r.text.split()) for r in apply_mix(docs, mixed).collect()) == sum(r.taken for r in mixed.collect())
