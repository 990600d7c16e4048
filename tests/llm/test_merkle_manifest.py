import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle_manifest as mm, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_of(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + arity]) for k in range(0, len(levels[-1]), arity)])
    return levels


def proof_of(levels, idx, arity):
    """[(siblings to the left, siblings to the right)] from the leaf up."""
    out = []
    for nodes in levels[:-1]:
        first = idx - idx % arity
        out.append((nodes[first:idx], nodes[idx + 1 : first + arity]))
        idx //= arity
    return out


def brute(rows, arity, altered=lambda r: None):
    """{(order, leaf): [(subroot, root, proof hex, folded root)]} of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], arity) for g in names}
    top = levels_of([trees[g][-1][0] for g in names], arity)
    out = []
    for t, g in enumerate(names):
        for idx, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            proof = proof_of(trees[g], idx, arity) + proof_of(top, t, arity)
            node = altered(r) or leaf
            for left, right in proof:
                node = h(*left, node, *right)
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], "".join(x for left, right in proof for x in left + right), node))
    return out


def rows_of(rng, n, langs):
    texts = ["", None, "é" * 40, "x", "日本語", "a longer text " * 9]
    return [(rng.choice([k, k, k, None]), rng.choice(["s1", None, ""]), rng.choice(langs), rng.choice([k, None, 0]), rng.choice(texts)) for k in range(n)]


@pytest.mark.parametrize("arity", [2, 3, 5])
@pytest.mark.parametrize("n,langs", [(1, ["en"]), (2, ["en"]), (7, ["en", None]), (60, ["en", "é", "z", "", None, "lone"]), (333, ["en"] * 20 + ["de", "fr"])])
def test_against_brute_force(spark, arity, n, langs, monkeypatch):
    monkeypatch.setattr(mm, "SMALL", 20)
    rng = random.Random(n * arity)
    rows = rows_of(rng, n, langs)
    rows += rows[:3] * 2
    df = spark.createDataFrame([(*r, 0, "clash", True) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree int, digest string, kept boolean").repartition(5)
    altered = F.when(F.col("doc_id") % 3 == 0, F.unhex(mm.leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")])))
    m = mm.manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"doc_id": F.col("doc_id"), "claimed": altered}, arity)
    out = m.rows.select("doc_id", "leaf", "subroot", F.lit(m.root).alias("root"), m.proof().alias("proof"), m.folded_root(F.coalesce(F.lower(F.hex("claimed")), "leaf")).alias("folded"))
    want = brute(rows, arity, lambda r: leaf_of((*r[:3], r[3] if r[3] is None else r[3] + 1, r[4])) if r[0] is not None and r[0] % 3 == 0 else None)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)


def test_unaltered_rows_lead_to_the_root(spark):
    rows = [(k, "s", "en" if k % 9 else "de", k, f"text {k}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    m = mm.manifest(df, ["doc_id", "text"], "lang", "doc_id", {"doc_id": F.col("doc_id")})
    assert m.rows.where(m.folded_root(F.col("leaf")) != m.root).count() == 0
    # any other leaf leads elsewhere, and so does another row's proof
    assert m.rows.where(m.folded_root(F.lit(h("other"))) == m.root).count() == 0
    # values are told apart by their lengths
    assert leaf_of(("a", "b1:c")) != leaf_of(("a1:b", "c"))
    one = spark.createDataFrame([("1:a", "b"), ("1", "a1:b"), (None, "-"), ("-", None)], "x string, y string").select(mm.leaf_digest([F.col("x"), F.col("y")]).alias("h"))
    assert len({r.h for r in one.collect()}) == 4


def test_no_rows_and_arity(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    m = mm.manifest(df, ["doc_id"], "lang", "doc_id", {"doc_id": F.col("doc_id")})
    assert m.root == "" and m.rows.count() == 0
    with pytest.raises(ValueError):
        mm.manifest(df, ["doc_id"], "lang", "doc_id", arity=1)


def test_query_on_given_rows(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    want = brute(rows, 2, lambda r: leaf_of((*r[:3], r[3] + 1, r[4])) if zlib.crc32(str(r[0]).encode()) % 7 == 0 else None)
    got = queries.op11_manifest(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == sorted((d, leaf, s, root, h(p), f, f == root) for d, leaf, s, root, p, f in want)
    assert 0 < sum(not r.verified for r in got) < len(got) / 4
