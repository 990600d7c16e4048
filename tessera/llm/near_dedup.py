"""MinHash near-duplicate detection.

1. Every text becomes its set of shingles, a signature of universal hash minima and a hash of the whole set. Texts of equal
   sets are one class from here on, shown by its smallest id.
2. Banding: classes whose signatures agree in all minima of a band share a bucket.
3. Signature verification: in a bucket, classes whose signatures agree well enough belong to one cluster.
4. Exact confirmation: in a cluster, two classes are linked if the similarity of their full sets reaches the threshold.
5. The links' connected components are the groups.

Steps 3 and 4 never emit all pairs of a group. Each group is first compared with its pivot, the member that shares the
most buckets with others. Those that pass are connected already. For step 4 the distance 1 - similarity is a metric:
a member that failed can only be near members whose distance to the pivot differs from its own by no more than
the threshold's, so the group is cut into blocks by that distance, blocks are bounded in bytes and rows, and only pairs of blocks
that hold a failed member and are close enough meet, each in a task of its own. Of a pair of blocks only links that connect
something new (a forest) are given out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.llm import minhash
from tessera.llm.common import checkpoint, looked_up, map_texts
from tessera.llm.components import connected_components

#: Distances to the pivot are cut into ranges of this width.
RANGE = 0.05
#: More bands of set sizes than there can be: a place is a range of distances times this and a band.
BANDS = 4096
#: Copies of a set from which its documents are looked up where they are.
MANY_COPIES = 256


def shingle_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, set_hash (16 bytes) and signature of every document; both null where there are no shingles."""
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("set_hash", T.BinaryType()), T.StructField("signature", T.BinaryType())]

    def run(texts):
        n, hashes, signatures = [], [], []
        for t in texts:
            s = minhash.shingle_hashes(t)
            n.append(len(s))
            hashes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            signatures.append(minhash.minima(s).tobytes() if len(s) else None)
        return [pa.array(n, pa.int64()), pa.array(hashes, pa.binary()), pa.array(signatures, pa.binary())]

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    return map_texts(own, "__text", ["id"], fields, run)


def _compare(kind: str):
    """(decode, compare) for payloads: signatures or full sets."""
    return (minhash._signature, minhash.agreeing) if kind == "signature" else (minhash._set, minhash.similarities)


def _with_pivot(joined: DataFrame, kind: str) -> DataFrame:
    """grp, id, pivot and how like the pivot each member is."""
    decode, compare = _compare(kind)
    schema = T.StructType([*joined.select("grp", "id", "pivot", "bytes").schema.fields, T.StructField("like", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                mine, other, pivots = (part.column(k).to_pylist() for k in ("payload", "pivot_payload", "grp"))
                like, by = np.zeros(len(mine)), {}
                for k, g in enumerate(pivots):
                    by.setdefault(g, []).append(k)
                for own in by.values():
                    for lo in range(0, len(own), 64):
                        some = own[lo : lo + 64]
                        like[some] = compare([decode(other[some[0]])], [decode(mine[k]) for k in some])[0]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in ("grp", "id", "pivot", "bytes")], pa.array(like)], names=schema.names)

    return joined.mapInArrow(run, schema)


def group_links(members: DataFrame, kind: str, least: float, *, metric: bool, block_bytes: int = 2 << 20, block_rows: int = 512) -> DataFrame:
    """Links (a, b) that connect the members of each group which `least` connects.

    members: grp, id, support, bytes, payload, checkpointed. metric: 1 - likeness obeys the triangle inequality.
    """
    best = F.max_by(F.struct("id", "payload"), F.struct(F.col("support"), -F.col("id")))
    # written, so that the join below reads it by an exchange of its own and Spark can split a large group there
    pivots = checkpoint(members.groupBy("grp").agg(best.alias("p")).select("grp", F.col("p.id").alias("pivot"), F.col("p.payload").alias("pivot_payload")))
    joined = members.join(pivots, "grp").where(F.col("id") != F.col("pivot"))
    compared = checkpoint(_with_pivot(joined, kind))
    star = compared.where(F.col("like") >= least).select(F.col("id").alias("a"), F.col("pivot").alias("b"))

    # what the pivot leaves open: members that failed, and those they may still be linked with
    failed = F.col("like") < least
    range_ = F.floor((1 - F.col("like")) / RANGE).cast("int") if metric else F.when(failed, 1).otherwise(0)
    # sets whose sizes differ by more than the threshold's factor can't be alike: only neighbouring bands of sizes meet
    band = F.floor(F.log(F.col("bytes").cast("double")) / max(0.01, float(np.log(1 / least)))).cast("int") if metric else F.lit(0)
    ranged = compared.withColumns({"range": range_ * BANDS + band, "failed": failed})
    sums = ranged.groupBy("grp", "range").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum(failed.cast("long")).alias("n_failed"))
    whole = sums.groupBy("grp").agg(F.sum("n").alias("all"), F.sum("bytes").alias("all_bytes"), F.sum("n_failed").alias("all_failed"))
    open_ = whole.where("all_failed > 0 AND all > 1")
    one = (F.col("all") <= block_rows) & (F.col("all_bytes") <= block_bytes)  # a group that fits into one block is one
    parts = F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("bytes") / block_bytes)).cast("int")
    blocks = sums.join(open_.select("grp", one.alias("one")), "grp").select(
        "grp", "one", F.when(F.col("one"), 0).otherwise(F.col("range")).alias("range"), F.when(F.col("one"), 1).otherwise(parts).alias("parts"), (F.col("one") | (F.col("n_failed") > 0)).alias("has_failed")
    ).distinct().groupBy("grp", "one", "range").agg(F.max("parts").alias("parts"), F.max("has_failed").alias("has_failed"))
    blocks = checkpoint(blocks)
    each = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x, y = each.alias("x"), each.alias("y")
    before = (F.col("x.range") < F.col("y.range")) | ((F.col("x.range") == F.col("y.range")) & (F.col("x.part") <= F.col("y.part")))
    away = lambda a, b: F.abs(a % BANDS - b % BANDS) <= 1
    steps = F.floor(F.col("y.range") / BANDS) - F.floor(F.col("x.range") / BANDS)
    close = ((steps - 1) * RANGE < 1 - least + 1e-9) & away(F.col("x.range"), F.col("y.range")) if metric else F.lit(True)
    pairs = x.join(y, (F.col("x.grp") == F.col("y.grp")) & before & close & (F.col("x.has_failed") | F.col("y.has_failed"))).select(
        F.col("x.grp").alias("grp"), F.struct("x.range", "x.part").alias("left"), F.struct("y.range", "y.part").alias("right"))
    pairs = pairs.withColumn("meet", F.xxhash64("left", "right"))
    sides = pairs.select("grp", "meet", F.explode(F.when(F.col("left") == F.col("right"), F.array(F.struct(F.lit(2).alias("side"), F.col("left").alias("at")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("at")), F.struct(F.lit(1).alias("side"), F.col("right").alias("at"))))).alias("s"))
    sides = sides.select("grp", "meet", F.col("s.side").alias("side"), F.col("s.at.range").alias("range"), F.col("s.at.part").alias("part"))
    salted = ranged.join(blocks.select(F.col("grp"), "one", F.col("range").alias("r"), "parts"), "grp").where(F.col("one") | (F.col("range") == F.col("r")))
    salted = salted.select("grp", "id", F.col("r").alias("range"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    meeting = salted.join(sides, ["grp", "range", "part"]).select("grp", "id", "meet", "side")
    decode, compare = _compare(kind)

    def links(table: pa.Table) -> pa.Table:
        ids, side, sets = table.column("id").to_pylist(), table.column("side").to_pylist(), [decode(p) for p in table.column("payload").to_pylist()]
        a, b = [k for k, s in enumerate(side) if s != 1], [k for k, s in enumerate(side) if s != 0]
        found = minhash.forest(compare([sets[k] for k in a], [sets[k] for k in b]) >= least, [ids[k] for k in a], [ids[k] for k in b]) if a and b else []
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    rest = meeting.join(members.select("grp", "id", "payload"), ["grp", "id"]).groupBy("grp", "meet").applyInArrow(links, "a long, b long")
    return star.union(rest)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs`.

    Two documents are linked if the Jaccard similarity of their sets of 5-word shingles is `threshold` or more;
    component_id is the smallest id that links reach, kept says that it is the document's own. Texts without words are
    linked with nothing; a text of fewer than five words is one shingle. A row with a null id has no component and is kept. Rows of
    equal id are one node: what links one of them links all. Bands and signature check follow from `threshold`, so that the chance
    of a miss is the same for all; a threshold too low for the signatures (under about 0.17) or above 1 is an error.
    """
    if not threshold <= 1:
        raise ValueError(f"no pair has similarity {threshold}")
    (n_bands, length), least = minhash.bands(threshold), minhash.least_agreeing(threshold) / minhash.HASHES
    own = checkpoint(shingle_table(docs, id_col=id_col, text_col=text_col))
    classes = own.where("id IS NOT NULL AND set_hash IS NOT NULL").groupBy("set_hash").agg(F.min("id").alias("rep"), F.first("signature").alias("signature"), F.count("*").alias("copies"))
    classes = checkpoint(classes)
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("signature", 4 * length * b + 1, 4 * length)) for b in range(n_bands)])
    keyed = classes.select(F.col("rep").alias("id"), F.explode(bands).alias("grp"))
    shared = keyed.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1")
    inside = checkpoint(keyed.join(shared, "grp"))
    support = inside.groupBy("id").agg(F.sum("n").alias("support"))
    signed = classes.select(F.col("rep").alias("id"), F.col("signature").alias("payload"), F.lit(4 * minhash.HASHES).cast("long").alias("bytes")).join(support, "id")
    members = checkpoint(inside.select("grp", "id").join(signed, "id").select("grp", "id", "support", "bytes", "payload"))
    clusters = checkpoint(connected_components(group_links(members, "signature", least, metric=False)))

    # full sets, made again of the texts of the clusters' members alone
    wanted = clusters.join(support, clusters["node"] == support["id"]).select(F.col("node"), F.col("component").alias("grp"), "support")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = texts.join(wanted, texts["id"] == wanted["node"]).select("grp", "id", "support", "text")

    def sets(batch):
        yield pa.array([minhash.shingle_hashes(t).tobytes() for t in batch], pa.binary())

    full = map_texts(texts, "text", ["grp", "id", "support"], [T.StructField("payload", T.BinaryType())], sets)
    full = checkpoint(full.where(F.octet_length("payload") > 0).select("grp", "id", "support", F.octet_length("payload").cast("long").alias("bytes"), "payload"))
    groups = connected_components(group_links(full, "set", threshold - 1e-12, metric=True))
    # only sets with copies or links have a component other than their document's id
    by_set = classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").where("copies > 1 OR component IS NOT NULL")
    by_set = checkpoint(by_set.select("set_hash", "copies", F.coalesce("component", "rep").alias("component")))
    hot = by_set.where(F.col("copies") > MANY_COPIES).select("set_hash", F.col("component").alias("hot"))
    n_hot = hot.count()
    known = looked_up(own, hot, ["set_hash"], n_hot) if n_hot else own.withColumn("hot", F.lit(None).cast("long"))
    alone = F.col("set_hash").isNull() | F.col("hot").isNotNull()  # texts without words, and those looked up
    rest = known.where(~alone).join(by_set.where(F.col("copies") <= MANY_COPIES).select("set_hash", "component"), "set_hash", "left")
    names = ["id", "n_shingles", "component"]
    out = known.where(alone).withColumn("component", F.col("hot")).select(names).union(rest.select(names))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    out = out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
