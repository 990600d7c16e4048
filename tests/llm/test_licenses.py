import re

from tessera.llm.licenses import NOTICES, PHRASES, Template, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for t in PHRASES:
        own = t.text.split()
        for k in range(len(w) - len(own) + 1):
            if w[k : k + len(own)] == own:
                places.append(k)
                labels.add(t.label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    None, "", "mit", "Released under the MIT License.", "under the mit, license under-the-MIT\nlicense", "under the mit the license",
    "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0. cc by nc cc by nc", "x " * 30_000 + "cc by nc",
    "under the \u212ait license cc by n\u212a", "per\u212aission", "apache  LICENSE\tversion 2 and UNDER THE MIT LICENSE", "cc by",
    "Permission is hereby granted, free of charge, to any person or company obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the software without restriction",
    "Redistribution and use in source and binary forms are permitted provided that it rains", "under the mit license " * 3,
]


def test_base_scan_is_brute_force(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x"), (None, TEXTS[3], "x")]
    out = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string").repartition(3)).collect()
    assert len(out) == len(rows)
    for r in out:
        text = TEXTS[3] if r.doc_id is None else TEXTS[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (r.score == 0) == (r.labels == "")


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = dict(map(tuple, docs.collect()))
    out = scan_licenses(docs).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])


def test_merged_diagonals_bridge_an_inserted_word(spark):
    out = {r.doc_id: r for r in scan_licenses(spark.createDataFrame([(13, TEXTS[13]), (14, TEXTS[14])], "doc_id long, text string")).collect()}
    assert out[13].labels == "mit" and 0.7 <= out[13].score < 1 and out[14].labels == ""
    [span] = out[13].spans
    assert (span.start, span.label) == (0, "mit")


def test_other_templates_and_empty(spark):
    df = spark.createDataFrame([(1, "do what you like with it")], "doc_id long, text string")
    assert scan_licenses(df, phrases=[Template("own", "what you like", True)], notices=[]).first().first_word == 1
    assert scan_licenses(df.limit(0)).count() == 0
    assert all(len(t.text.split()) >= 3 and t.text == t.text.lower() for t in [*PHRASES, *NOTICES])
