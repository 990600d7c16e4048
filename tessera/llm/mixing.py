"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks. DataFrame functions only.

The documents of a source, in an order that a seed fixes, form a stream of words that is cut into blocks of equal size.
Seats are apportioned to the sources by the highest quotients target / (2 seat - 1). Whole passes over a source come first; the
rest of its seats is apportioned to its shards (runs of neighbouring blocks) the same way, and in each shard
the seed says where the run of chosen blocks starts.

Of the quotients, only those that can decide are made: with n parties and N seats, party p gets at least
p (N - n/2)/W - 1/2 and at most p (N + n/2)/W + 1/2 of them, so about 2n quotients are ranked however many seats there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.common import checkpoint, looked_up

WORD = r"[^\x20\x09-\x0D]+"
#: Most equal rows that are one entry of a source's stream, and most buckets of a source.
COPIES, MOST_BUCKETS = 1024, 1 << 16
#: Parts in which rows that agree in all columns are numbered.
PARTS = 64


def row_key(id_: Column, text: Column, source: Column) -> Column:
    """Hash of a row's id, text and source; what is null differs from what is empty."""
    own = F.coalesce(id_.cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.coalesce(F.md5(text.cast("string")), F.lit("")), id_.isNull().cast("int"), source.isNull().cast("int"), F.length(own), own, F.coalesce(source.cast("string"), F.lit(""))))


def sainte_lague(parties: DataFrame, group: list[str], party: list[str], weight: str, seats: str) -> DataFrame:
    """Adds `quota`: the seats of each row among the rows of its group, which agree on `seats`.

    Equal quotients go to the party that comes first by `party`. Parties of weight 0 or null get none.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    n, total = F.count(F.when(F.col(weight) > 0, 1)).over(w), F.sum(weight).over(w)
    share = F.when(F.col(weight) > 0, F.col(weight) / total)
    low = F.greatest(F.lit(0), F.floor(share * (F.col(seats) - n / 2) - 0.5) - 1).cast("long")
    high = (F.ceil(share * (F.col(seats) + n / 2) + 0.5) + 1).cast("long")
    base = parties.withColumns({"__low": F.coalesce(low, F.lit(0)), "__high": F.coalesce(high, F.lit(0))})
    base = base.withColumn("__left", F.col(seats) - F.sum("__low").over(w))
    tries = base.where(F.col("__high") > F.col("__low")).withColumn("__k", F.explode(F.sequence(F.col("__low") + 1, F.col("__high"))))
    rank = F.row_number().over(w.orderBy(F.desc(F.col(weight) / (2 * F.col("__k") - 1)), *[F.asc_nulls_last(c) for c in party], "__k"))
    won = tries.withColumn("__rank", rank).where(F.col("__rank") <= F.col("__left")).groupBy(*group, *party).agg(F.count("*").alias("__won"))
    keys = [*group, *party]
    out = base.alias("a").join(won.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys], "left")
    return out.select(*[F.col(f"a.{c}") for c in parties.columns], (F.col("a.__low") + F.coalesce("b.__won", F.lit(0))).alias("quota"))


def source_targets(sources: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most_repeats: int = 3) -> DataFrame:
    """`sources` (source, source_size) with weight and target.

    Sources by code point, null last, weigh `weights` in turn. The targets share the total by weight; none is above
    `most_repeats` times its size, and what that cuts off is shared again among the rest.
    """
    alone = Window.partitionBy(F.lit(0))  # one row for each source
    at = F.row_number().over(alone.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (at % len(weights) + 1).cast("int"))
    with_weight = sources.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size").cast("double") * most_repeats)
    # by rising most / weight the capped sources come first; theta: words for a weight of 1 if those before this one are capped; it falls from the first uncapped source on
    order = alone.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    theta = (F.sum("source_size").over(alone) - F.coalesce(F.sum("most").over(before), none)) / (F.sum("weight").over(alone) - F.coalesce(F.sum("weight").over(before), none))
    level = F.max(F.when(F.col("theta") * F.col("weight") <= F.col("most"), F.col("theta"))).over(alone)
    return with_weight.withColumn("theta", theta).withColumn("level", level).select("source", "source_size", "weight", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most_repeats: int = 3,
    seed: int = 17,
    blocks_per_source: int = 4096,
    shards_per_source: int = 16,
    rows_per_bucket: int = 2_000,
    ranges: bool = False,
) -> DataFrame:
    """doc_id, size, source, source_size, target, taken for every document; `taken` counts the words the mix takes of it.

    size: words `[^\\x20\\x09-\\x0D]+` of the whole text, 0 for null. A document's words are taken at most `most_repeats` times.
    The blocks have ceil(total / (sources * blocks_per_source)) words, so a source misses its target by one block or two.
    Equal ids and repeated rows are each mixed; without documents or words nothing is taken.

    ranges: also `row_key`, a hash of id, text and source, and `ranges`, the chosen words [begin, end) of the document, counted
    from 0, that are taken once more than the rest: at most 2 for each shard, in order, none touching the next.

    The order within a source is that of md5(seed, id), then of id, size and row_key. Rows that agree in all of these are one entry of
    the stream, counted and split into entries of at most COPIES copies. A source is cut into buckets of the order, of about
    `rows_per_bucket` entries (more where that made over MOST_BUCKETS), summed first, so that no task holds a whole source. A bucket with
    more than twice as many, of rows that share an id or have none, is ordered by a hash of the entry first and cut by
    that. How much is chosen before a word follows from its block's shard by arithmetic, so the tables that are joined have a row
    for each source, or `shards_per_source` rows; only the sources themselves are ranked in one task.
    """
    key = row_key(*(F.col(f"`{c}`") for c in (id_col, text_col, source_col))) if ranges else F.lit("")
    sized = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("row_key"),
    )
    sized = sized.groupBy("doc_id", "source", "size", "row_key").agg(F.count("*").alias("copies"))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    sized = sized.withColumn("h", F.conv(F.substring(h, 1, 15), 16, 10).cast("long"))
    sized = checkpoint(sized.withColumn("skey", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    each = F.ceil(F.col("copies") / COPIES)
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum(each).alias("rows"))
    n_sources, total = sources.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    seats = max(1, n_sources * blocks_per_source)
    block = max(1, -(-total // seats))
    targets = source_targets(sources.select("source", "source_size"), weights=weights, most_repeats=most_repeats)
    quotas = sainte_lague(targets.withColumn("seats", F.lit(-(-total // block))), [], ["source"], "target", "seats")
    quotas = quotas.withColumn("blocks", F.greatest(F.ceil(F.col("source_size") / block), F.lit(1)).cast("long"))
    quotas = quotas.withColumn("quota", F.least("quota", F.col("blocks") * most_repeats))
    quotas = quotas.withColumn("passes", F.floor(F.col("quota") / F.col("blocks"))).withColumn("rest", F.col("quota") - F.col("passes") * F.col("blocks"))
    quotas = checkpoint(quotas.join(sources.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))

    # shards: runs of neighbouring blocks of a source
    shards = quotas.select("source", "rest", "blocks", F.least(F.col("blocks"), F.lit(shards_per_source)).alias("shards"))
    shards = shards.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    bound = lambda s: F.floor(s * F.col("blocks") / F.col("shards"))
    shards = shards.withColumn("first", bound(F.col("shard"))).withColumn("n", bound(F.col("shard") + 1) - F.col("first"))
    shards = sainte_lague(shards, ["source"], ["shard"], "n", "rest").withColumn("quota", F.least("quota", "n"))
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("shard"))), 1, 15), 16, 10).cast("long")
    # the chosen blocks of a shard are a run that goes round: [start, start + quota), where it passes the end also from 0
    earlier = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("start", F.pmod(start, F.col("n"))).withColumn("before", F.coalesce(F.sum("quota").over(earlier), F.lit(0)))
    shards = checkpoint(shards.select("source", "shard", "first", "n", "quota", "start", "before"))

    # where each entry stands in the stream of its source
    skey = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    buckets = F.least(F.greatest(F.lit(1), F.ceil(F.col("rows") / rows_per_bucket)), F.lit(MOST_BUCKETS)).cast("long")
    own = quotas.select(skey.alias("skey"), "source_size", "target", "passes", "rest", "blocks", buckets.alias("buckets"), (F.col("rows") / buckets).alias("usual"))
    placed = looked_up(sized, own, ["skey"], n_sources)
    entries = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("copies") / COPIES).cast("long") - 1)
    placed = placed.withColumn("entry", F.explode(entries)).withColumn("copies", F.least(F.lit(COPIES), F.col("copies") - F.col("entry") * COPIES).cast("long"))
    placed = placed.withColumn("bucket", F.floor(F.shiftright("h", 36) * F.col("buckets") / F.lit(1 << 24)))
    parts = F.when(F.col("n") > 2 * F.col("usual") + 100, F.ceil(F.col("n") / F.greatest("usual", F.lit(1.0)))).otherwise(1).cast("long")
    full = placed.groupBy("skey", "bucket", "usual").agg(F.count("*").alias("n")).withColumn("parts", parts).where("parts > 1").select("skey", "bucket", "parts")
    full = checkpoint(full)
    placed = looked_up(placed, full, ["skey", "bucket"], full.count()).withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    placed = placed.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id", "size", "row_key", "entry"), F.col("parts"))).otherwise(0).cast("long"))
    words = F.col("size") * F.col("copies")
    sums = placed.groupBy("skey", "bucket", "part").agg(F.sum(words).alias("words"))
    sums = sums.withColumn("offset", F.coalesce(F.sum("words").over(Window.partitionBy("skey").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("skey", "bucket", "part").orderBy("h", F.asc_nulls_first("doc_id"), "size", "row_key", "entry").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("begin", F.coalesce(F.sum(words).over(within), F.lit(0)))
    placed = placed.join(sums.select("skey", "bucket", "part", "offset"), ["skey", "bucket", "part"])
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    placed = placed.withColumn("at", F.col("begin") + F.col("offset") + F.col("copy") * F.col("size"))
    n_shards = n_sources * shards_per_source
    shards = shards.withColumn("skey", skey)
    table = shards.select("skey", F.col("shard").alias("k"), "first", "n", "quota", "start", "before")
    for name, edge in (("low", F.col("at")), ("high", F.col("at") + F.col("size"))):
        # the words chosen of a stream before one of its words, from the shard that the word lies in
        placed = placed.withColumn("b", F.floor(edge / block).cast("long"))
        placed = placed.withColumn("k", F.floor(((F.col("b") + 1) * F.least("blocks", F.lit(shards_per_source)) - 1) / F.col("blocks")).cast("long"))
        placed = looked_up(placed, table, ["skey", "k"], n_shards)
        i, end, none = F.col("b") - F.col("first"), F.col("start") + F.col("quota"), F.lit(0)
        ahead = F.greatest(none, F.least(i, end, F.col("n")) - F.col("start")) + F.least(i, F.greatest(none, end - F.col("n")))
        chosen = (F.pmod(i - F.col("start"), F.col("n")) < F.col("quota")).cast("long")
        words = (F.col("before") + ahead) * block + chosen * (edge - F.col("b") * block)
        # a stream may end where a block ends: that edge lies in no block, and all that is chosen is before it
        placed = placed.withColumn(name, F.when(F.col("first").isNull(), F.col("rest") * block).otherwise(words)).drop("b", "k", "first", "n", "quota", "start", "before")
    taken = F.col("size") * F.col("passes") + F.col("high") - F.col("low")
    out = ["doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken")]
    if not ranges:
        return placed.select(*out)
    placed = looked_up(placed, _runs(shards, block), ["skey"], n_shards)
    inside = lambda r: F.struct((F.greatest(r["begin"], F.col("at")) - F.col("at")).alias("begin"), (F.least(r["end"], F.col("at") + F.col("size")) - F.col("at")).alias("end"))
    own = F.filter(F.transform(F.coalesce("runs", F.array().cast("array<struct<begin:bigint,end:bigint>>")), inside), lambda r: r["begin"] < r["end"])
    return placed.select(*out, "row_key", own.alias("ranges"))


def _runs(shards: DataFrame, block: int) -> DataFrame:
    """skey (of a source) and runs: the chosen words [begin, end) of its stream, at most 2 for each shard, those that touch made one."""
    end = F.col("start") + F.col("quota")
    part = lambda lo, hi: F.struct(((F.col("first") + lo) * block).cast("long").alias("begin"), ((F.col("first") + hi) * block).cast("long").alias("end"))
    both = F.array(part(F.lit(0), F.greatest(F.lit(0), end - F.col("n"))), part(F.col("start"), F.least(end, F.col("n"))))
    each = shards.select("skey", F.explode(both).alias("run")).where("run.begin < run.end")
    # a run starts where no run ends, and the other way round: begins and ends pair up by their rank
    begins, ends = F.array_sort(F.collect_list("run.begin")), F.array_sort(F.collect_list("run.end"))
    both = each.groupBy("skey").agg(begins.alias("b"), ends.alias("e"))
    both = both.select("skey", F.array_sort(F.array_except("b", "e")).alias("b"), F.array_sort(F.array_except("e", "b")).alias("e"))
    return both.select("skey", F.zip_with("b", "e", lambda b, e: F.struct(b.alias("begin"), e.alias("end"))).alias("runs"))


def apply_mix(docs: DataFrame, mixed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents as the mix takes them: each whole text as often as it is taken whole, and a row for each range of words of the rest.

    mixed: of `mix(docs, ranges=True)`. Every row of `docs` gets what was chosen for it; rows that repeat id, text and source are told apart by
    their number alone. Rows of which nothing is taken are left out. A `mixed` without ranges goes by id and names no words: the first count.
    """
    rest, copies = F.col("taken") % F.col("size"), F.floor(F.col("taken") / F.col("size")).cast("int")
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    named = "ranges" in mixed.columns
    key = row_key(*(F.col(f"`{c}`") for c in (id_col, text_col, source_col))) if named else F.coalesce(F.concat(F.lit("="), F.col(f"`{id_col}`").cast("string")), F.lit(""))
    theirs = F.col("row_key") if named else F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    parts = F.col("ranges") if named else F.array(F.struct(F.lit(0).cast("long").alias("begin"), rest.cast("long").alias("end")))
    own = mixed.select(theirs.alias("__key"), F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"), F.when((F.col("size") > 0) & (rest > 0), parts).otherwise(none).alias("parts"))
    # of rows that agree in the key few are taken differently, those where a run begins or ends: each way is kept once, with the number of the last row taken so
    upto = F.sum("n").over(Window.partitionBy("__key").orderBy("copies", "parts").rowsBetween(Window.unboundedPreceding, 0))
    own = own.groupBy("__key", "copies", "parts").agg(F.count("*").alias("n")).select("__key", F.struct(upto.alias("upto"), "copies", "parts").alias("take"))
    own = checkpoint(own.groupBy("__key").agg(F.sort_array(F.collect_list("take")).alias("__all")))
    out = docs.withColumn("__key", key)
    # rows whose key is taken in several ways are numbered: those where a run of chosen words begins or ends
    several = own.where(F.size("__all") > 1).select("__key", F.lit(True).alias("__several"))
    n = several.count()
    if n:
        salted = looked_up(out, several, ["__key"], n).withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int"))
        parts = salted.where("__several").groupBy("__key", "__part").agg(F.count("*").alias("__n"))
        earlier = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        parts = checkpoint(parts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n"))
        within = F.row_number().over(Window.partitionBy("__key", "__part").orderBy("__key"))
        some = looked_up(salted.where("__several"), parts, ["__key", "__part"], n * PARTS).withColumn("__number", within + F.col("__before"))
        rest = salted.where("__several IS NULL").withColumns({"__before": F.lit(None).cast("long"), "__number": F.lit(1).cast("long")})
        out = some.unionByName(rest).drop("__several", "__part", "__before")
    else:
        out = out.withColumn("__number", F.lit(1).cast("long"))
    whole = F.struct(F.lit(-1).cast("long").alias("begin"), F.lit(-1).cast("long").alias("end"))
    out = out.join(own, "__key")
    mine = F.when(F.size("__all") > 1, F.get(F.filter("__all", lambda x: x["upto"] >= F.col("__number")), 0)).otherwise(F.get("__all", 0))
    out = out.withColumn("__mine", mine).drop("__all", "__number")
    out = out.withColumn("__way", F.explode(F.concat(F.array_repeat(whole, F.col("__mine.copies")), F.col("__mine.parts"))))
    words = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1)
    some = F.array_join(F.slice(words, (F.col("__way.begin") + 1).cast("int"), (F.col("__way.end") - F.col("__way.begin")).cast("int")), "")
    text = F.when(F.col("__way.begin") < 0, F.col(f"`{text_col}`")).otherwise(some)
    return out.withColumn(text_col, text).drop("__key", "__mine", "__way")
