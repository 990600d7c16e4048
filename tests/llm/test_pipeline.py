import corpus_pipeline
from tessera.llm.decontaminate import build_search
from tessera.llm.common import words
from tests.llm.test_decontaminate import brute
from tests.llm.test_mixing import targets
from tests.llm.test_near_dedup import brute as brute_groups


def test_stages_one_after_the_other(spark, sf_dir, tmp_path):
    """What every stage keeps, against a plain version of its decision on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 4 < 2")
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = out.collect()
        if name != "sharding":
            assert out.columns == columns
        kept = {r.doc_id for r in rows}
        assert kept <= set(before)
        if name == "toxicity":
            gone = set(before) - kept
            assert gone and gone & toxic and len(gone - toxic) < 0.1 * len(before)
        elif name == "near_dedup":
            assert kept == {d for d, (_, c) in brute_groups(before, 80, 100).items() if c == d}
        elif name == "decontamination":
            search = build_search([t.encode() for _, t in items], 10)
            suspects = {d for d, t in before.items() if any(s.find(words(t.encode())) for s in search)}
            assert kept == set(before) - suspects and all(brute(before[d], items)[1] for d in suspects)
        elif name == "mixing":
            sources = {r.doc_id: (r.source, len(r.text.split())) for r in docs.collect()}
            sizes, taken = {}, {}
            for s, n in sources.values():
                sizes[s] = sizes.get(s, 0) + n
            for r in rows:
                assert r.text in before[r.doc_id] and r.n_chars == len(r.text)
                taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
            assert all(abs(taken.get(s, 0) - t) <= 12 + 0.002 * t for s, t in targets(sizes).items())
        else:
            by = {}
            for r in rows:
                by.setdefault(r.shard, []).append(r)
            assert len(rows) == docs.count() and all(sorted(r.slot for r in g) == list(range(len(g))) for g in by.values())
        docs = out


def test_run_and_registration(spark, sf_dir):
    import __spark_entry__

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 10
    out = names["pipeline"](spark, "/root/testdata/sf0.001")
    assert {"doc_id", "shard", "slot"} <= set(out.columns) and out.count() > 0


def test_near_copies_from_four_fifths_on(spark, sf_dir):
    """A copy of similarity 0.82 goes; on the given documents what stays is what exact links of 80/100 leave."""
    base = [f"w{i}" for i in range(104)]
    edit = [*base[:94], *(f"new{i}" for i in range(10))]  # 90 of 110 shingles
    own = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(edit)), (3, "something else")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, own, sf_dir).collect()) == [1, 3]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 4 < 2")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()}
    assert kept == {d for d, (_, c) in brute_groups(texts, 80, 100).items() if c == d}


def test_mixing_stage_gives_what_is_chosen(spark, sf_dir):
    """Every row of the stage is a whole text or a run of its words, not only first words; the rows go on to shards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 4 = 1")
    before = {r.doc_id: r.text for r in docs.collect()}
    out = corpus_pipeline.mixing(spark, docs, sf_dir)
    rows = out.collect()
    assert out.columns == docs.columns and all(r.text in before[r.doc_id] and r.n_chars == len(r.text) for r in rows)
    assert any(not before[r.doc_id].startswith(r.text) for r in rows)
    sizes, taken = {}, {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    assert all(abs(taken.get(s, 0) - t) <= 12 + 0.002 * t for s, t in targets(sizes).items())
    assert corpus_pipeline.sharding(spark, out, sf_dir).count() == len(rows)
