"""License scans by diagonal voting. DataFrame functions only.

Every rolling run of three words of a document that begins with a word of a template, as all others can't meet one, is hashed and
joined with the runs of the license templates (a small fixed table, broadcast). A hit votes for its diagonal, the document position less the template position. Votes
are added up by diagonal, neighbouring diagonals are merged (a word put in or left out moves the votes by one), and the
span of the merged diagonal is verified by how much of the template it covers. The join compares the words
themselves besides the hash, so a hit is never a collision.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

GRAM = 3

#: What stands between words; upper-case letters are words too before they are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False  #: a phrase that counts only where all its words stand consecutively


#: Phrases of the base scan.
PHRASES = [
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
]
#: Opening notices of common public licenses.
NOTICES = [
    Template("mit", "released under the mit license"),
    Template("mit", "licensed under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("apache-2", "licensed under the apache license version 2 0"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    Template("cc-by", "creative commons attribution 4 0 international license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("gpl", "licensed under the gnu general public license"),
    Template("lgpl", "licensed under the gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
]


def lowered(text: Column) -> Column:
    """A-Z lower-cased. lower() also changes letters beyond ASCII, which no template has; the Kelvin sign, the only one that
    would turn into an ASCII word, is kept apart."""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u2126")))


def listed_words(text: Column) -> Column:
    """All words of a text, in order."""
    return F.array_remove(F.split(lowered(text), BETWEEN), "")


def template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """One row for each run of GRAM words of each template: a table that is as small as the list of templates."""
    rows = []
    for k, t in enumerate(templates):
        w = t.text.split()
        if len(w) < GRAM:
            raise ValueError(f"a template needs {GRAM} words: {t.text!r}")
        rows += [(k, t.label, t.exact, len(w) - GRAM + 1, i, *w[i : i + GRAM]) for i in range(len(w) - GRAM + 1)]
    table = spark.createDataFrame(rows, "template int, label string, exact boolean, grams int, at int, t0 string, t1 string, t2 string")
    return table.withColumn("gram", F.xxhash64("t0", "t1", "t2"))


def license_spans(docs: DataFrame, templates: list[Template], *, key: list[str], text_col: str = "text", drift: int = 2, cover: float = 0.7) -> DataFrame:
    """Verified spans: the key columns, template, label, exact, start, end (words [start, end)), and score.

    score: share of the template's runs of words that the span holds; a phrase needs all on one diagonal, a notice at least
    `cover` on diagonals that are at most `drift` apart from one to the next. Equal rows of `docs` are one document.
    """
    text = F.col(f"`{text_col}`")
    listed = docs.where(text.isNotNull()).select(*key, listed_words(text).alias("__w"))
    at = lambda i: F.get("__w", i)
    first = sorted({w for t in templates for w in t.text.split()[: 1 - GRAM]})
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size("__w") - GRAM, F.lit(0))), lambda i: at(i).isin(first) & at(i + 2).isNotNull())
    rolled = listed.select(*key, F.explode(F.transform(places, lambda i: F.struct(i.alias("pos"), at(i).alias("w0"), at(i + 1).alias("w1"), at(i + 2).alias("w2")))).alias("w"))
    hashed = rolled.select(*key, "w.*").withColumn("gram", F.xxhash64("w0", "w1", "w2"))
    grams = F.broadcast(template_grams(docs.sparkSession, templates))
    same = (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2"))
    hits = hashed.join(grams, "gram").where(same).select(*key, "template", "label", "exact", "grams", "at", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))
    # votes of a diagonal; a document given twice votes once
    votes = hits.dropDuplicates([*key, "template", "at", "pos"]).groupBy(*key, "template", "label", "exact", "grams", "diagonal").agg(
        F.count("*").alias("votes"), F.min("pos").alias("start"), (F.max("pos") + GRAM).alias("end"), F.min("at").alias("low"), F.max("at").alias("high"))
    # neighbouring diagonals of a notice are merged while their distance is at most drift
    order = Window.partitionBy(*key, "template").orderBy("diagonal")
    apart = F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(order) > drift)
    runs = votes.withColumn("run", F.sum(F.coalesce(apart.cast("int"), F.lit(0))).over(order))
    spans = runs.groupBy(*key, "template", "label", "exact", "grams", "run").agg(F.sum("votes").alias("votes"), F.min("start").alias("start"), F.max("end").alias("end"))
    score = F.least(F.lit(1.0), F.col("votes") / F.col("grams"))
    fits = F.when(F.col("exact"), F.col("votes") == F.col("grams")).otherwise((score >= cover) & (F.col("end") - F.col("start") <= 2 * (F.col("grams") + GRAM - 1)))
    return spans.where(fits).select(*key, "template", "label", "exact", "start", "end", score.alias("score"))


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: list[Template] = PHRASES, notices: list[Template] = NOTICES, **how) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans for every row of `docs`.

    spans: array of (label, start, end, score), sorted, of phrases and notices; base columns count the phrases alone.
    labels join the distinct labels of all spans; score is the best score of a span, else 0. Null and empty texts have no
    words and no spans. Rows with equal id and text get the same result.
    """
    templates = [*phrases, *notices]
    keyed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    spans = license_spans(keyed, templates, key=["doc_id", "h"], **how)
    base = F.when(F.col("exact"), F.col("start"))
    found = spans.groupBy("doc_id", "h").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("score").alias("score"),
        F.array_sort(F.collect_set(F.struct("start", "end", "label", "score"))).alias("spans"),
    )
    counted = keyed.select("doc_id", "h", F.coalesce(F.size(listed_words(F.col("text"))), F.lit(0)).cast("long").alias("n_words")).alias("d")
    out = counted.join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.h") == F.col("f.h")), "left")
    return out.select(
        "d.doc_id", "d.n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )
