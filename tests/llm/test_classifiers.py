import zlib
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, strategies as st

from tessera.llm import queries
from tessera.llm.factorization import FactorizationMachine
from tessera.llm.quality import STATISTICS, BoostedTrees, fit_quality, score_quality, statistics
from tessera.llm.toxicity import fit_toxicity, score_toxicity


def planted_pairs(n, seed):
    """Texts of about 25 neutral words. Toxic where exactly one of two words stands: each word alone says nothing."""
    rng = np.random.default_rng(seed)
    for _ in range(n):
        own = [f"w{k}" for k in rng.integers(0, 300, 25)]
        a, b = rng.random(2) < 0.5
        own += ["dolt"] * int(a) + ["folk"] * int(b)
        yield " ".join(rng.permutation(own)), int(a != b)


def test_pairs_decide_where_words_alone_say_nothing(spark):
    rows = [(k, t, y) for k, (t, y) in enumerate(planted_pairs(4000, 1))]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_toxicity(table.select("doc_id", "text"), table.where("doc_id < 3000").select("doc_id", "toxic"))
    held = table.where("doc_id >= 3000")
    out = score_toxicity(held, model).toPandas()
    assert ((out.score >= 0.5) == (out.toxic == 1)).mean() > 0.97
    without = replace(model, v=model.v * 0)
    plain = score_toxicity(held, without).toPandas()
    assert ((plain.score >= 0.5) == (plain.toxic == 1)).mean() < 0.8  # a sum of weights gets three of the four cases right at most


def test_a_rare_pair_gets_an_interaction(spark):
    """Insult and group word meet in about 1.4 % of the texts; only there is a text toxic."""
    rng, rows = np.random.default_rng(3), []
    for k in range(4000):
        own = [f"w{j}" for j in rng.integers(0, 300, 25)]
        a, b = rng.random(2) < 0.12
        rows.append((k, " ".join(own + ["dolt"] * int(a) + ["folk"] * int(b)), int(a and b)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_toxicity(table, table)
    at = np.searchsorted(model.terms, [zlib.crc32(w) % model.buckets for w in (b"dolt", b"folk")])
    assert model.v[at[0]] @ model.v[at[1]] > 0.1
    seen = spark.createDataFrame([("a dolt of w1 folk",), ("a dolt of w1",), ("those folk of w1",)], "text string")
    both, one, other = [r.score for r in score_toxicity(seen, model).collect()]
    assert both > 0.3 > max(one, other)


@given(st.lists(st.lists(st.integers(0, 39), max_size=12, unique=True), max_size=8), st.integers(0, 99))
def test_scores_are_explicit_sums_over_pairs(rows, seed):
    rng = np.random.default_rng(seed)
    known = np.sort(rng.choice(40, 20, replace=False))
    model = FactorizationMachine(known, -0.4, rng.normal(size=20), rng.normal(size=(20, 3)), 40)
    want = []
    for row in rows:
        own = [k for k in range(20) if known[k] in row]
        z = -0.4 + sum(model.w[k] for k in own) + sum(model.v[i] @ model.v[j] for n, i in enumerate(own) for j in own[:n])
        want.append(1 / (1 + np.exp(-z)))
    assert model.scores([np.array(r, dtype=np.int64) for r in rows]) == pytest.approx(want)


@pytest.mark.parametrize("seed", range(6))
def test_splits_are_the_best_of_all(seed):
    """Every node of a tree of two levels takes, of all features and cuts between its bins, the one with the largest gain."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(160, 4)), 1 if seed % 2 else 6)
    x[:, 3] = 2.0  # nothing to cut
    y = ((x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(scale=0.4, size=160)) > 0.4).astype(float)
    model = BoostedTrees.fit(x, y, trees=1, depth=2, rate=0.3, bins=16, l2=1.0, least=2.0)
    q = y.mean()
    g, h = q - y, np.full(len(y), q * (1 - q))
    value = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)

    def gains(inside):
        for j in range(4):
            for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1])):
                left, right = inside & (x[:, j] <= cut), inside & (x[:, j] > cut)
                if h[left].sum() >= 2 and h[right].sum() >= 2:
                    yield value(left) + value(right) - value(inside), j, cut

    nodes, at = [np.ones(len(y), bool)], np.zeros(len(y), int)
    for k in range(3):
        inside, j, cut = nodes[k], model.feature[0, k], model.threshold[0, k]
        left = inside & (x[:, j] <= cut)
        best = max((v for v, _, _ in gains(inside)), default=0)
        assert (value(left) + value(inside & ~left) - value(inside) if np.isfinite(cut) else 0) == pytest.approx(max(best, 0), abs=1e-6)
        nodes += [left, inside & ~left]
    for k, inside in enumerate(nodes[3:]):
        at[inside] = k
        assert model.leaf[0, k] == pytest.approx(-0.3 * g[inside].sum() / (h[inside].sum() + 1.0))
    z = model.base + model.leaf[0][at]
    assert model.scores(x) == pytest.approx(1 / (1 + np.exp(-z)))


def test_trees_walk_as_one_row_at_a_time():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = BoostedTrees.fit(x, y, trees=30)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95
    for k in (0, 17, 99):
        z = model.base
        for t in range(len(model.leaf)):
            node = 0
            for level in range(model.depth):
                at = 2**level - 1 + node
                node = 2 * node + int(x[k, model.feature[t, at]] > model.threshold[t, at])
            z += model.leaf[t, node]
        assert model.scores(x[k : k + 1])[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_statistics_of_odd_texts():
    for text in (None, b"", b"   ", b"\n\n", "é".encode() * 50_000, b"a" * 100_000):
        own = statistics(text)
        assert len(own) == len(STATISTICS) and np.isfinite(own).all()


@pytest.mark.parametrize("fit, score, label", [(fit_toxicity, score_toxicity, "toxic"), (fit_quality, score_quality, "quality")])
def test_edges(spark, fit, score, label):
    texts = ["you stupid idiot", "a fine day for a walk", None, "", "stupid " * 5000] * 20
    docs = spark.createDataFrame([(k, t, 0.0) for k, t in enumerate(texts)] + [(None, "x", 0.0), (3, None, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, int("stupid" in (t or ""))) for k, t in enumerate(texts)] + [(None, 1), (1, None)], f"doc_id long, {label} int")
    rows = score(docs, fit(docs, labels)).collect()
    assert len(rows) == len(texts) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert min(r.score for r in rows if r.text == texts[0]) > max(r.score for r in rows if r.text == texts[1])
    for empty in (labels.limit(0), labels.where("doc_id IS NULL")):
        assert {r.score for r in score(docs, fit(docs, empty)).collect()} == {0.5}
    assert score(docs.limit(0), fit(docs.limit(0), labels)).count() == 0


def held_out(spark, sf_dir, name, label):
    out = queries.queries()[name](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").toPandas()
    return out.score.to_numpy(), out.predicted.to_numpy(), out[label].to_numpy()


def test_held_out_toxicity(spark, sf_dir):
    score, predicted, y = held_out(spark, sf_dir, "op2_toxicity", "toxic")
    assert score[y == 1].mean() > score[y == 0].mean() + 0.3
    assert predicted[y == 0].mean() < 0.05 and predicted[y == 1].mean() > 0.5


def test_held_out_quality(spark, sf_dir):
    _, predicted, y = held_out(spark, sf_dir, "op8_quality", "quality")
    assert (predicted == y).mean() > 0.95


def test_score_depends_on_the_text_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = queries.toxicity_model(spark, sf_dir, docs)
    one = docs.limit(50).select("doc_id", "text")
    other = one.selectExpr("doc_id + 1000000 AS doc_id", "text", "'xx' AS lang", "'yy' AS source")
    a = sorted(r.score for r in score_toxicity(one, model).collect())
    assert a == sorted(r.score for r in score_toxicity(other, model).collect())
