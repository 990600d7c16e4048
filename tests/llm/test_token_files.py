import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import queries, token_files as tf

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
LIB.encode_special_tokens = True
OWN = tf.Encoder(PATH, most=50)


def lib(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text(alphabet=" \n\t'stredaA1é€ \x1c²½,.　ſƀ’", max_size=40), st.text(max_size=30), st.text(alphabet=[chr(c) for c in range(0x180)], max_size=30), st.text(alphabet=[chr(c) for c in range(33)] + ["a", "1"], max_size=30), st.lists(st.sampled_from(["the", "don't", "DON'T", " ", "  ", "\n", "x" * 70, "12,5", "Über"]), max_size=12).map(" ".join)))
def test_ids_are_those_of_the_whole_text(text):
    assert np.frombuffer(OWN(text), "<u2").tolist() == lib(text)


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, other = tf.Encoder(path), Tokenizer.from_file(path)
    assert not own.in_pieces
    for text in ("The cat sat.", "", "  Über den  Wolken"):
        assert np.frombuffer(own(text), "<u2").tolist() == other.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), max_size=30), min_size=1, max_size=5), st.sampled_from([1, 2]))
def test_codes_round_trip(rows, bits):
    rows = [np.array(r, np.uint32) & (0xFFFF if bits == 1 else 0xFFFFFFFF) for r in rows]
    pairs = [tf.pack(r, bits) for r in rows]
    per = 8 // bits
    found, at = tf.unpack(b"".join(c for c, _ in pairs), b"".join(d for _, d in pairs), bits), 0
    for r, (control, data) in zip(rows, pairs, strict=True):
        assert found[at : at + len(r)].tolist() == r.tolist()
        assert len(control) == -(-len(r) // per) and len(data) == sum(max(1, -(-int(v).bit_length() // 8)) for v in r) + -len(r) % per
        at += len(r) + -len(r) % per


def brute(rows):
    """(doc_id, start, n, crc) in ascending order; rows of equal id in any order share a multiset of (n, crc)."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*lib(text), 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def through(spark, tmp_path, rows, name, **how):
    folder = f"file://{tmp_path}/{name}"
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, ids string, start int").repartition(3)
    tf.write_token_files(docs, folder, PATH, **how)
    return folder, [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in tf.read_token_files(spark, folder).collect()]


def test_files_against_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    words = ["alpha", "beta's", "Gamma,", "7", "naïve", "über", "中文", "\n", "", "<|endoftext|>"]
    rows = [(k * 3 - 50, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for k in range(300)] + [(10_000, None), (10_001, ""), (-9_000, "long " * 50_000)]
    rng.shuffle(rows)
    monkeypatch.setattr(tf, "CHUNK_IDS", 500)
    for shard_ids, name in ((1000, "many"), (10**9, "one")):
        folder, got = through(spark, tmp_path, rows, name, shard_ids=shard_ids)
        assert sorted(got) == sorted(brute(rows))
        manifest = spark.read.parquet(f"{folder}/manifest").orderBy("shard").collect()
        assert (len(manifest) > 3) == (name == "many") and sum(m.docs for m in manifest) == len(rows)
        assert not (tmp_path / name / "ids").exists()
    # the files alone, read in the order of the manifest, hold all ids in ascending order of documents
    vocab, stream = np.frombuffer((tmp_path / "many/vocab.bin").read_bytes(), "<u4"), []
    for m in spark.read.parquet(f"{tmp_path}/many/manifest").orderBy("shard").collect():
        with open(tmp_path / "many" / m.file, "rb") as file:
            stream += [(d, x.tolist()) for ids, _, found in tf.read_chunks(file, vocab) for d, x in zip(ids, found, strict=True)]
    assert [d for d, _ in stream] == sorted(d for d, _ in rows)
    counts = np.bincount([i for _, x in stream for i in x])
    assert (np.diff(counts[vocab]) <= 0).all()


def test_repeated_rows_null_ids_and_empty_tables(spark, tmp_path):
    rows = [(5, "same row")] * 400 + [(5, "another"), (None, "no id"), (None, None), (1, "first")]
    _, got = through(spark, tmp_path, rows, "repeated", shard_ids=200)
    own = brute(rows)
    assert sorted((d is not None, d or 0, n, c) for d, _, n, c in got) == sorted((d is not None, d or 0, n, c) for d, _, n, c in own)
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == [r[0] for r in own]
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    assert through(spark, tmp_path, [], "empty")[1] == []
    with pytest.raises(ValueError):
        list(tf.read_chunks(__import__("io").BytesIO(b"x" * 64), np.zeros(1, "<u4")))


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op12_token_files(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and [t for _, t in out.dtypes] == ["bigint"] * 4
    assert sorted(map(tuple, out.collect())) == brute(rows)


def test_files_are_smaller_than_fixed_widths(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tf.write_token_files(docs, f"file://{tmp_path}/f", PATH)
    row = spark.read.parquet(f"{tmp_path}/f/manifest").agg(F.sum("ids"), F.sum("bytes")).first()
    assert row[1] < 1.4 * row[0]
