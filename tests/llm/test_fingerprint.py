import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm.fingerprint import LEAF, compare_with_edit, differing_branches, likeness, nodes, with_fingerprint, with_next

RUN = re.compile(r"[ \t]*[^ \t]+(?:[ \t]+[^ \t]+){0,7}[ \t]*|[ \t]+")


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def brute(text):
    leaves = [[md5(m.group(0)) for m in RUN.finditer(p)] for p in text.split("\n")]
    sections = ",".join("".join(p) for p in leaves).replace(",,", ";").split(";")
    root = md5("".join(md5("".join(md5(p) for p in s.split(","))) for s in sections))
    shown = ",".join("".join(h[:LEAF] for h in p) for p in leaves).replace(",,", ";")
    own = shown.split(";")
    levels = [s for s in own if s.strip(",")], [p for s in own for p in s.split(",") if p], [h[:LEAF] for p in leaves for h in p]
    return f"{root}:{shown}", [Counter(x) for x in levels]


def like(a, b):
    if a[0].split(":")[0] == b[0].split(":")[0]:
        return 1.0
    return 2 * sum((x & y).total() for x, y in zip(a[1], b[1])) / (2 + sum(x.total() + y.total() for x, y in zip(a[1], b[1])))


def check(spark, rows, **how):
    out = compare_with_edit(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string").repartition(3), **how).collect()
    texts = {d: t or "" for d, t in rows}
    order = sorted(texts, key=lambda d: (d is not None, d))
    assert len(out) == len(rows)
    for r in out:
        own, following = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        assert (r.n_chars, r.edited) == (len(own), edited)
        a, b, c = brute(own), brute(edited), brute(following)
        assert (r.fingerprint, r.edited_fingerprint) == (a[0], b[0])
        assert abs(r.near_edited - like(a, b)) < 1e-12 and abs(r.near_next - like(a, c)) < 1e-12


def test_against_brute_force(spark):
    rows = [(k * 7 - 50, f"Paragraph {k} has some words of its own, and more of them {k}.\n\nNext {k % 3} section\tis here " * (k % 9)) for k in range(60)]
    rows += [(10_000, None), (10_001, ""), (10_002, "\n\n\n"), (10_003, " \t "), (10_004, "é𝄞" * 30_000), (2**62, "last"), (None, "first of all")]
    for bucket_bytes in (1 << 24, 2000, 100):
        check(spark, rows, bucket_bytes=bucket_bytes)


def test_one_row_none_and_ties(spark):
    check(spark, [(5, "alone in the world")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert compare_with_edit(empty).count() == 0
    tied = spark.createDataFrame([(1, "aaaa"), (1, "bbbb"), (1, "aaaa"), (2, "cccc")], "doc_id long, text string")
    out = [(r.doc_id, r.text, r.edited) for r in compare_with_edit(tied).collect()]
    assert len(out) == 4 and sorted(out) == sorted((r.doc_id, r.text, r.edited) for r in compare_with_edit(tied.repartition(4), bucket_bytes=4).collect())


def test_equal_texts_have_equal_fingerprints(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = compare_with_edit(docs).select("text", "fingerprint").distinct().collect()
    assert len({r.text for r in rows}) == len({r.fingerprint for r in rows}) == len(rows)


def test_most_rows_under_one_id(spark):
    """Rows of one id, and those without, fill many buckets and follow one another by a hash of the text."""
    rows = [(None if k % 3 == 0 else 7, f"text number {k} of many with a few words") for k in range(540)] + [(k, f"other {k}") for k in range(20, 80)] + [(7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = []
    for n, bucket_bytes in ((3, 1 << 24), (5, 300)):
        tabled = docs.repartition(n).withColumns({"bucket": F.lit(1), "cell": F.lit("c"), "key": F.lit(2.0)})
        got = with_next(tabled, ["text"], id_col="doc_id", text_col="text", bucket_bytes=bucket_bytes)
        assert got.columns == ["doc_id", "text", "bucket", "cell", "key", "next_text"]
        out.append(sorted((str(r.doc_id), str(r.text), str(r.next_text)) for r in got.collect()))
    assert out[0] == out[1] and len(out[0]) == len(rows)
    assert sorted(t for _, t, _ in out[0]) == sorted(u for _, _, u in out[0])
    hashed = [(r.doc_id, r.text) for r in docs.orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text")).collect()]
    want = sorted((str(d), str(t), str(hashed[(k + 1) % len(hashed)][1])) for k, (d, t) in enumerate(hashed))
    assert out[0] == want


def compared(spark, pairs):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    df = with_fingerprint(with_fingerprint(df, "a", "a_"), "b", "b_").withColumns({f"{c}_nodes": nodes(F.col(c)) for c in ("a_fingerprint", "b_fingerprint")})
    out = df.select("k", likeness("a_fingerprint", "b_fingerprint").alias("like"), differing_branches(F.col("a_fingerprint"), F.col("b_fingerprint")).alias("at")).orderBy("k").collect()
    return [r.like for r in out], [[(d.section, d.paragraph, list(d.runs)) for d in r.at] for r in out]


def test_trees_with_other_roots_are_less_than_alike(spark):
    run = "one two three four five six seven eight "
    pairs = [(run, run * 5), ("x\n\ny", "y\nx"), ("a\n\nb", "b\n\na"), ("a\nb", "a\n\nb"), ("same text", "same text"), ("", ""), ("", "words"), ("", "\n\n"), ("a b", "c d")]
    got, _ = compared(spark, pairs)
    assert got[4:6] == [1.0, 1.0] and got[6:9] == [0.0, 0.0, 0.0] and all(0 < v < 1 for v in got[:4])
    assert got[0] < 0.3 and got == [like(brute(a), brute(b)) for a, b in pairs]


def test_the_edited_paragraph_is_found(spark):
    text = "\n\n".join("\n".join(f"section {s} paragraph {p} " + " ".join(f"word{s}.{p}.{w}" for w in range(40)) for p in range(6)) for s in range(30))
    other = text.replace("word17.4.20", "changed").replace("section 29 paragraph 0", "section 29, paragraph 0")
    (near, same), (at, none) = compared(spark, [(text, other), (text, text)])
    # four words stand before the numbered ones: word 20 is in run 3
    assert at == [(17, 4, [3]), (29, 0, [0])] and none == [] and same == 1.0 and 0.9 < near < 1
    assert compared(spark, [(text, "")])[1][0][0] == (0, 0, list(range(6)))
