import random
import re
from itertools import combinations
from math import comb

import numpy as np
import pytest

from tessera.llm import common, components, minhash, near_dedup
from tessera.llm.components import connected_components
from tessera.llm.near_dedup import group_links, near_duplicates


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs, num, den):
    """Smallest reachable id by exact links over all pairs."""
    sets = {d: shingles(t) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(docs), 2):
        common = len(sets[a] & sets[b])
        if common and den * common >= num * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in docs}


def check(spark, docs, threshold=0.85):
    df = spark.createDataFrame([(d, t, "other", -1) for d, t in docs.items()], "doc_id long, text string, kept string, component_id int").repartition(4)
    rows = near_duplicates(df, threshold=threshold).collect()
    assert len(rows) == len(docs)
    expected = brute(docs, round(threshold * 100), 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_against_brute_force(spark):
    """Chains of edits, a hot group of near copies about the threshold, exact copies, unrelated texts, edges."""
    rng = random.Random(5)
    docs, base = {}, [f"w{rng.randrange(3000)}" for _ in range(150)]
    for k in range(120):
        docs[k] = " ".join(edited(rng, base, rng.randrange(0, 9)))
    chain = [f"c{i}" for i in range(200)]
    for k in range(200, 230):
        docs[k] = " ".join(chain)
        chain = edited(rng, chain, 2)
    for k in range(300, 340):
        docs[k] = "The same text given many times" if k % 2 else " ".join(f"z{rng.randrange(50)}" for _ in range(12))
    docs |= {400: None, 401: "", 402: " \n ", 403: "one two", 404: "ONE two", 405: "one  two", 406: "É two", 407: "é two", 408: "word " * 20_000, 409: "word " * 9}
    check(spark, docs)


def test_on_documents(spark, sf_dir):
    check(spark, dict(map(tuple, spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 3 = 0").select("doc_id", "text").collect())))


def test_repeated_rows_and_nulls(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(7, text), (7, text), (3, text), (None, text), (None, None), (9, None)], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_duplicates(df).collect())
    assert rows == [(-1, -1, True), (-1, -1, True), (3, 3, True), (7, 3, False), (7, 3, False), (9, 9, True)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_blocks_lose_no_link(spark):
    """Members that the pivot leaves open meet in small blocks and are connected as all pairs would connect them."""
    rng = np.random.default_rng(3)
    base = np.arange(100, dtype=np.uint64)
    sets = {}
    for k in range(60):
        own = base.copy()
        own[rng.choice(100, rng.integers(0, 30), replace=False)] = rng.integers(1000, 1100, 1)[0] + np.arange(1, dtype=np.uint64)
        sets[k] = np.unique(own)
    like = minhash.similarities(list(sets.values()), list(sets.values()))
    for a, b in combinations(range(60), 2):
        assert abs(like[a, b] - len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))) < 1e-9
    members = spark.createDataFrame([(1, k, 1, 8 * len(s), bytearray(s.tobytes())) for k, s in sets.items()], "grp long, id long, support long, bytes long, payload binary")
    for metric in (True, False):
        links = group_links(members, "set", 0.8, metric=metric, block_rows=7)
        got = {r.node: r.component for r in connected_components(links).collect()}
        parent = {k: k for k in sets}
        for a, b in combinations(range(60), 2):
            if like[a, b] >= 0.8:
                x, y = parent[a], parent[b]
                parent = {k: min(x, y) if v in (x, y) else v for k, v in parent.items()}
        assert {k: got.get(k, k) for k in sets} == parent


@pytest.mark.parametrize("hub, most", [(10**9, 50_000), (20, 50_000), (20, 0)])
def test_components(spark, monkeypatch, hub, most):
    monkeypatch.setattr(components, "HUB", hub)
    monkeypatch.setattr(common, "MOST_BROADCAST", most)
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(100, 160)] + [(1000, k) for k in range(1001, 1400)] + [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(150)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [50_000, 0])
def test_large_groups_of_copies(spark, monkeypatch, most):
    monkeypatch.setattr(near_dedup, "MANY_COPIES", 5)
    monkeypatch.setattr(common, "MOST_BROADCAST", most)
    base = [f"w{i}" for i in range(40)]
    docs = {k: " ".join(base) for k in range(10, 60)} | {k: " ".join([*base, "end"]) for k in range(100, 110)} | {k: "" for k in range(200, 220)}
    docs |= {300: "other text of five words", 301: "other text of five words", 302: "alone it stands here now"}
    check(spark, docs)


def test_bands_follow_the_threshold(spark):
    """The chance of a miss is bounded for every threshold, and pairs just above a low one are all found."""
    assert minhash.bands(0.85) == (16, 4) and minhash.least_agreeing(0.85) == 38
    for t in [k / 100 for k in range(17, 101)]:
        n, length = minhash.bands(t)
        assert n * length <= minhash.HASHES and (1 - t**length) ** n <= minhash.MISS_BANDS
        assert sum(comb(64, k) * t**k * (1 - t) ** (64 - k) for k in range(minhash.least_agreeing(t))) <= minhash.MISS_CHECK
    for wrong in (0.1, 1.5):
        with pytest.raises(ValueError):
            near_duplicates(spark.createDataFrame([], "doc_id long, text string"), threshold=wrong)
    docs = {}
    for k in range(60):
        docs[2 * k] = " ".join(f"p{k}w{i}" for i in range(104))
        docs[2 * k + 1] = " ".join(f"p{k}w{i}" if i < 74 else f"q{k}w{i}" for i in range(104))  # 70 of 130 shingles
    check(spark, docs, threshold=0.5)
