"""Document fingerprints: Merkle trees over paragraphs and sections. DataFrame functions only.

A section ends at an empty line, a paragraph at a line end; a paragraph is hashed in runs of at most eight words, counted from its
start, so that a change inside a long paragraph still leaves equal branches before it. A node's hash is the hash of
its children's hashes, the root's that of the sections'. Equal roots mean equal texts; trees are compared by the branches they share
at each level, and where two differ, their differing branches say in which section, paragraph and run.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Runs of a paragraph: at most eight words with the blanks around them; together they are the whole paragraph.
RUN = r"[ \t]*[^ \t]+(?:[ \t]+[^ \t]+){0,7}[ \t]*|[ \t]+"
#: Hexadecimal digits that a leaf shows in a fingerprint.
LEAF = 8
#: Cells in which the bounds of the buckets of neighbours are looked up.
CELLS = 4096


def tree(text: Column) -> Column:
    """The hashes of the runs of each paragraph, in page order: array of arrays."""
    return F.transform(F.split(text, "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(RUN), 0), F.md5))


def _sections(leaves: Column) -> Column:
    """Sections divided by ';', paragraphs by ','; an empty line is an empty paragraph."""
    return F.replace(F.array_join(F.transform(leaves, lambda p: F.array_join(p, "")), ","), F.lit(",,"), F.lit(";"))


def root(leaves: Column) -> Column:
    """Hash of the sections' hashes, each the hash of its paragraphs' hashes, each the hash of its runs' hashes."""
    section = lambda s: F.md5(F.array_join(F.transform(F.split(s, ","), F.md5), ""))
    return F.md5(F.array_join(F.transform(F.split(_sections(leaves), ";"), section), ""))


def shown(leaves: Column) -> Column:
    """The leaves as a fingerprint shows them."""
    return F.transform(leaves, lambda p: F.transform(p, lambda h: F.substring(h, 1, LEAF)))


def with_fingerprint(df: DataFrame, text_col: str, prefix: str = "") -> DataFrame:
    """Adds `<prefix>fingerprint`, "root:sections" with the leaves of every section.

    Null counts as the empty text, which has one empty paragraph. A column of that name is replaced.
    """
    full, cut = f"__{prefix}full", f"__{prefix}cut"
    df = df.withColumn(full, tree(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    df = df.withColumn(cut, shown(full))
    print_ = F.concat(root(F.col(full)), F.lit(":"), _sections(F.col(cut)))
    return df.withColumn(f"{prefix}fingerprint", print_).drop(full, cut)


def nodes(fingerprint: Column) -> Column:
    """struct(sections, paragraphs, leaves): the branches of each level of a fingerprint's tree as it shows them, from first to last, those
    without a leaf left out. A branch is what it shows of all its leaves, so equal branches are equal subtrees."""
    body = F.substring_index(fingerprint, ":", -1)
    sections = F.filter(F.split(body, ";"), lambda s: s.rlike("[0-9a-f]"))
    paragraphs = F.filter(F.split(body, "[;,]"), lambda p: p != "")
    return F.struct(sections.alias("sections"), paragraphs.alias("paragraphs"), F.regexp_extract_all(body, F.lit(f"[0-9a-f]{{{LEAF}}}"), 0).alias("leaves"))


def in_common(own: Column, other: Column) -> Column:
    """How many elements two arrays share, each as often as both have it: one walk over both, sorted together."""
    both = F.array_sort(F.concat(F.transform(own, lambda x: F.struct(x.alias("x"), F.lit(0).alias("side"))), F.transform(other, lambda x: F.struct(x.alias("x"), F.lit(1).alias("side")))))
    # of each element first those of `own` come, which wait, then those of `other`, each of which takes one
    start = F.struct(F.lit("").alias("x"), F.lit(0).alias("waiting"), F.lit(0).alias("n"))

    def step(s: Column, e: Column) -> Column:
        waiting = F.when(s["x"] == e["x"], s["waiting"]).otherwise(0)
        taken = (e["side"] == 1) & (waiting > 0)
        return F.struct(e["x"].alias("x"), F.when(e["side"] == 0, waiting + 1).when(taken, waiting - 1).otherwise(waiting).alias("waiting"), F.when(taken, s["n"] + 1).otherwise(s["n"]).alias("n"))

    return F.aggregate(both, start, step)["n"]


def likeness(a: str, b: str) -> Column:
    """Of two columns of fingerprints, whose `nodes` stand in <column>_nodes: twice the branches that both trees have, at every level and as
    often as both have them, over the branches of both; 1 where the roots agree. Trees with other roots are below 1, whatever they share."""
    own, other = F.col(f"{a}_nodes"), F.col(f"{b}_nodes")
    levels = ("sections", "paragraphs", "leaves")
    n = sum((F.size(own[k]) + F.size(other[k]) for k in levels), F.lit(2))
    agree = F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1)
    return F.when(agree, 1.0).otherwise(2.0 * sum((in_common(own[k], other[k]) for k in levels[1:]), in_common(own["sections"], other["sections"])) / n)


def differing_branches(own: Column, other: Column) -> Column:
    """Where a text differs from another, by their fingerprints: array of struct(section, paragraph, runs), the places from 0 of the
    paragraphs of `own` that `other` hasn't got, and in each the places of the runs it hasn't got. Empty where the roots agree.

    The trees are descended from the root: only sections that the other tree hasn't got are looked into, and of these only such paragraphs.
    """
    body = lambda f: F.substring_index(f, ":", -1)
    runs = lambda p: F.regexp_extract_all(p, F.lit(f"[0-9a-f]{{{LEAF}}}"), 0)
    missing = lambda mine, theirs: F.filter(F.transform(mine, lambda x, k: F.struct(k.alias("at"), x.alias("x"))), lambda e: ~F.array_contains(theirs, e["x"]))
    their_paragraphs, their_runs = F.split(body(other), "[;,]"), runs(body(other))
    sections = missing(F.split(body(own), ";"), F.split(body(other), ";"))
    paragraphs = F.flatten(F.transform(sections, lambda s: F.transform(missing(F.split(s["x"], ","), their_paragraphs), lambda p: F.struct(s["at"].alias("section"), p["at"].alias("paragraph"), p["x"].alias("x")))))
    found = F.transform(paragraphs, lambda p: F.struct(p["section"].alias("section"), p["paragraph"].alias("paragraph"), F.transform(missing(runs(p["x"]), their_runs), lambda r: r["at"]).alias("runs")))
    return F.when(F.substring_index(own, ":", 1) == F.substring_index(other, ":", 1), F.slice(found, 1, 0)).otherwise(found)


def _bucket_table(spark, bounds: list[int], parts: dict[int, int], low: int, high: int) -> tuple[DataFrame, Column, Column]:
    """A table of CELLS equal ranges of the key with the bounds inside each and the parts of each bucket; the cell of `__key`;
    how many bounds of its cell a row is past."""
    width = max(1, -(-(high - low + 1) // CELLS))
    cells: dict[int, list[int]] = {}
    for b in bounds:
        cells.setdefault((b - low) // width, []).append(b)
    rows = []
    for c in range(CELLS):
        below = bisect_right(bounds, low + c * width - 1)
        rows.append((c, below, cells.get(c, []), [parts.get(below + k, 1) for k in range(len(cells.get(c, [])) + 1)]))
    table = spark.createDataFrame(rows, "__cell long, __below int, __bounds array<bigint>, __parts array<int>")
    return table, F.expr(f"cast((cast(__key AS decimal(20, 0)) - {low}) div {width} AS bigint)"), F.size(F.filter("__bounds", lambda b: b <= F.col("__key")))


def with_next(docs: DataFrame, columns: list[str], *, id_col: str, text_col: str, bucket_bytes: int = 4 << 20, most_buckets: int = 1 << 16) -> DataFrame:
    """`docs` with next_<column> of the document that follows by ascending id; the first follows the last.

    Null ids come first; equal ids are ordered by a hash of the text. The rows are dealt once, to buckets of the order that hold
    about `bucket_bytes` of text (more if that made over `most_buckets`), and the first rows of a bucket are dealt to the one
    before it as well. An id with more text than two buckets has buckets of its own, cut by the hash of the text, so only rows that
    agree in id and text are never parted. The driver sees the bounds of the buckets and the ids that fill several.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63)))
    text = F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0))
    total, low, high = docs.select(key.alias("key"), text.alias("n")).agg(F.sum("n"), F.min("key"), F.max("key")).first()
    if low is None:
        return docs.select("*", *[F.col(f"`{c}`").alias(f"next_{c}") for c in columns])
    own = docs.withColumns({"__key": key, "__hash": F.xxhash64(F.col(f"`{text_col}`"))})
    n = min(most_buckets, -(-total // bucket_bytes))
    bounds: list[int] = []
    parts: dict[int, int] = {}
    if n > 1:
        bounds = sorted({b for b in own.agg(F.percentile_approx("__key", [i / n for i in range(1, n)], max(10_000, 10 * n))).first()[0] if b > low})
        # ids that fill more than two buckets: only buckets so full can hold one, and there are at most half as many as buckets
        table, cell, past = _bucket_table(spark, bounds, parts, low, high)
        sized = docs.select(key.alias("__key"), text.alias("n")).withColumn("__cell", cell).join(F.broadcast(table), "__cell").withColumn("bucket", F.col("__below") + past)
        most = 2 * max(bucket_bytes, total // most_buckets)
        full = [r["bucket"] for r in sized.groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > most).collect()]
        if full:
            wide = spark.createDataFrame([(b,) for b in full], "bucket int")
            heavy = sized.join(F.broadcast(wide), "bucket", "left_semi").groupBy("__key").agg(F.sum("n").alias("n")).where(F.col("n") > most).collect()
            bounds = sorted({*bounds, *(k for r in heavy for k in (r["__key"], r["__key"] + 1) if low < k <= high)})
            parts = {bisect_right(bounds, r["__key"]): -(-2 * r["n"] // most) for r in heavy}
    table, cell, past = _bucket_table(spark, bounds, parts, low, high)
    spread = F.shiftright(F.col("__hash"), 32) + F.lit(1 << 31)  # 0 to 2^32 - 1, in the order of the hash
    part = F.floor(spread * F.element_at("__parts", past + 1) / F.lit(1 << 32)).cast("int")
    own = own.withColumn("__cell", cell).join(F.broadcast(table), "__cell").withColumns({"__base": F.col("__below") + past, "__part": part})
    own = own.drop("__cell", "__below", "__bounds", "__parts")
    slim = own.select("__base", "__part", "__key", "__hash")
    firsts = sorted(slim.groupBy("__base", "__part").agg(F.min(F.struct("__key", "__hash")).alias("first")).collect(), key=lambda r: (r["__base"], r["__part"]))
    places = spark.createDataFrame([(r["__base"], r["__part"], k, tuple(r["first"])) for k, r in enumerate(firsts)], "__base int, __part int, __bucket int, __first struct<__key:long,__hash:long>")
    own = own.join(F.broadcast(places), ["__base", "__part"])  # a row for each bucket
    # a row: (bucket, 0 its own place, 1 only to be seen by the row before it; 2 as that, after the last row)
    place = lambda b, kind: F.struct(b.cast("int").alias("bucket"), F.lit(kind).alias("kind"))
    leads = F.struct("__key", "__hash") == F.col("__first")
    dealt = F.array_compact(F.array(
        place(F.col("__bucket"), 0),
        F.when(leads & (F.col("__bucket") > 0), place(F.col("__bucket") - 1, 1)),
        F.when(leads & (F.col("__bucket") == 0), place(F.lit(len(firsts) - 1), 2)),
    ))
    dealt = own.select(*[F.col(f"`{c}`") for c in docs.columns], "__key", "__hash", F.explode(dealt).alias("__place"))
    dealt = dealt.withColumns({"__bucket": F.col("__place.bucket"), "__kind": F.col("__place.kind")}).drop("__place")
    order = Window.partitionBy("__bucket").orderBy((F.col("__kind") == 2), "__key", "__hash")
    following = F.lead(F.struct(*[F.col(f"`{c}`") for c in columns])).over(order)
    out = dealt.withColumn("__next", following).where("__kind = 0")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"__next.{c}").alias(f"next_{c}") for c in columns])


def compare_with_edit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_chars, text, edited text and both fingerprints with their likenesses, for every row of `docs`.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document's. near_edited and near_next are likenesses of fingerprints, from 0 to 1.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    own = with_next(with_fingerprint(slim, "text"), ["text", "fingerprint"], id_col="doc_id", text_col="text", **how)
    own = own.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    own = with_fingerprint(own.withColumn("edited", edited), "edited", "edited_")
    own = own.withColumns({f"{c}_nodes": nodes(F.col(c)) for c in ("fingerprint", "edited_fingerprint", "next_fingerprint")})
    return own.select(
        "doc_id", "n_chars", "text", "edited", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
