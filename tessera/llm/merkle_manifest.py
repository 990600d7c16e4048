"""A Merkle manifest of a table: one tree over the rows of each group, one over the groups' roots, a proof for every row.

Every level is a table of nodes (tree, idx, n, digest), n being the number of nodes of the tree in that level. A level is joined with itself by
the index of each sibling - idx XOR 1 in binary trees, else the other slots of the run of `arity` consecutive nodes - and the rows in slot zero,
which then hold all digests of their run, give the nodes of the next level. From the highest level down every node then gets its siblings and
those of the nodes above it: its proof. Digests are lower-case hex SHA-256 of the concatenated hex digests below; tables hold their 32 bytes.

Levels are written to a folder that the cluster shares, so lineage ends at each, and there are as many as the logarithm of the rows. Levels
of at most SMALL nodes, a number known beforehand, are joined by broadcast; others by tree and index, which no key can make uneven.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessera.llm.common import checkpoint_dir, looked_up

#: Nodes of a level that may be broadcast: 32 bytes each, and 32 for each sibling up to the root where proofs are handed down.
SMALL = 16_384
#: Levels of proofs that are joined before the result is written.
JOINED = 4


def leaf_digest(values: list[Column]) -> Column:
    """Hex SHA-256 of the values' texts, each as its number of UTF-8 bytes, a colon and itself, or as `-` where it is null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _up(n: Column, arity: int) -> Column:
    """n / arity, rounded up."""
    more = n + (arity - 1)
    return ((more - more % arity) / arity).cast("long")


@dataclass
class Store:
    """Tables in a folder of the manifest's own."""

    spark: SparkSession
    folder: str

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")


def numbered(rows: DataFrame, tree: str, order: list[str], store: Store, name: str) -> tuple[DataFrame, DataFrame]:
    """`rows` with idx, the place of each in its tree by `order` from 0, and (tree, n) of each tree.

    Rows are sorted into ranges of (tree, order, place in the written table), so equal rows, too, may be parted, and a tree as large as
    the table spreads over all ranges; only counts of each range and tree are added up.
    """
    rows = store.put(rows, f"{name}-given").withColumn("__place", F.monotonically_increasing_id())
    keys = [tree, *order, "__place"]
    at = F.monotonically_increasing_id()  # range << 33 | row of the range
    rows = store.put(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__place").withColumn("__at", at), name)
    rows = rows.withColumn("__range", F.shiftright("__at", 33))
    counts = rows.groupBy("__range", tree).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(tree).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = store.put(counts.withColumn("__before", before), f"{name}-counts")
    placed = looked_up(rows, counts.drop("__n"), ["__range", tree], counts.count())
    idx = F.col("__at") - F.col("__first") + F.col("__before")
    return placed.withColumn("idx", idx).drop("__at", "__range", "__first", "__before"), counts.groupBy(tree).agg(F.sum("__n").alias("n"))


def _with_siblings(nodes: DataFrame, arity: int, small: bool) -> DataFrame:
    """A level joined with itself: adds proof, the digests of the node's siblings from left to right, and parent where it stands in slot zero."""
    slot = F.col("idx") % arity
    out = nodes
    for k in range(1, arity):
        index = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + (slot + k) % arity
        sibling = nodes.select(F.col("tree").alias("__tree"), F.col("idx").alias("__idx"), F.col("digest").alias(f"__d{k}"))
        out = out.withColumn("__sibling", index).join(F.broadcast(sibling) if small else sibling, (F.col("tree") == F.col("__tree")) & (F.col("__sibling") == F.col("__idx")), "left").drop("__tree", "__idx", "__sibling")
    digests = [F.coalesce(f"__d{k}", F.lit(b"")) for k in range(1, arity)]
    # the k-th sibling stands in slot (slot + k) % arity: first those that went round to the left, then those to the right
    left = [F.when(slot + k >= arity, d).otherwise(F.lit(b"")) for k, d in enumerate(digests, 1)]
    right = [F.when(slot + k < arity, d).otherwise(F.lit(b"")) for k, d in enumerate(digests, 1)]
    parent = F.unhex(F.sha2(F.concat(_hex(F.col("digest")), *map(_hex, digests)), 256))
    out = out.withColumn("proof", F.concat(*left, *right)).withColumn("parent", F.when((slot == 0) & (F.col("n") > 1), parent))
    return out.drop(*[f"__d{k}" for k in range(1, arity)])


@dataclass
class Forest:
    """Trees built level by level; levels[0] keeps the columns that its nodes came with."""

    levels: list[DataFrame]
    bounds: list[int]
    arity: int

    def roots(self) -> DataFrame:
        """(tree, digest)"""
        lone = self.levels[0].where("n = 1").select("tree", "digest")
        return reduce(DataFrame.union, [level.where((F.col("idx") == 0) & F.col("n").between(2, self.arity)).select("tree", F.col("parent").alias("digest")) for level in self.levels], lone)

    def proofs(self, store: Store, name: str) -> DataFrame:
        """The nodes of level 0 with all siblings up to the root in proof."""
        above = None
        for k in range(len(self.levels) - 1, -1, -1):
            own = self.levels[k].drop("parent")
            if above is not None:
                up = above.select(F.col("tree").alias("__tree"), F.col("idx").alias("__idx"), F.col("proof").alias("__proof"))
                run = ((F.col("idx") - F.col("idx") % self.arity) / self.arity).cast("long")
                own = own.withColumn("__run", run).join(F.broadcast(up) if self.bounds[k + 1] <= SMALL else up, (F.col("tree") == F.col("__tree")) & (F.col("__run") == F.col("__idx")), "left")
                own = own.withColumn("proof", F.concat("proof", F.coalesce("__proof", F.lit(b"")))).drop("__tree", "__idx", "__run", "__proof")
            above = store.put(own, f"{name}-proofs-{k:02d}") if k and k % JOINED == 0 else own
        return above


def forest(nodes: DataFrame, rows: int, trees: int, height: int, arity: int, store: Store, name: str) -> Forest:
    """nodes: tree, idx, n, digest and further columns; `rows` of them in `trees` trees, none of more than `height` levels."""
    levels, bounds = [], []
    for k in range(max(height, 1)):
        bound = -(-rows // arity**k) + trees
        small = bound <= SMALL
        made = _with_siblings(nodes, arity, small)
        levels.append(store.put(made.coalesce(1) if small else made, f"{name}-level-{k:02d}"))
        bounds.append(bound)
        up = levels[-1].where("parent IS NOT NULL")
        nodes = up.select("tree", ((F.col("idx") / arity).cast("long")).alias("idx"), _up(F.col("n"), arity).alias("n"), F.col("parent").alias("digest")).where("n > 1")
    return Forest(levels, bounds, arity)


def _height(n: int, arity: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def folded(leaf: Column, proof: Column, idx: Column, n: Column, arity: int, height: int) -> Column:
    """Hex digest that a leaf (hex) and its proof lead to, for place `idx` in a tree of `n` leaves of at most `height` levels."""
    if not height:
        return leaf

    def step(s: Column, _: Column) -> Column:
        slot = s["idx"] % arity
        others = F.least(F.lit(arity).cast("long"), s["n"] - s["idx"] + slot) - 1
        left = _hex(F.substring(s["proof"], s["at"] + 1, (32 * slot).cast("int")))
        right = _hex(F.substring(s["proof"], s["at"] + 1 + (32 * slot).cast("int"), (32 * (others - slot)).cast("int")))
        up = F.struct(
            F.sha2(F.concat(left, s["digest"], right), 256).alias("digest"), (s["at"] + 32 * others).cast("int").alias("at"),
            ((s["idx"] - slot) / arity).cast("long").alias("idx"), _up(s["n"], arity).alias("n"), s["proof"].alias("proof"),
        )
        return F.when(s["n"] > 1, up).otherwise(s)

    start = F.struct(leaf.alias("digest"), F.lit(0).alias("at"), idx.cast("long").alias("idx"), n.cast("long").alias("n"), proof.alias("proof"))  # a column inside a lambda would meet the caller's aliases
    return F.aggregate(F.sequence(F.lit(1), F.lit(height)), start, step)["digest"]


@dataclass
class Manifest:
    """rows: `carry` columns, leaf, subroot (hex), idx, n, proof and the same of the groups' tree as top_idx, top_n, top_proof (bytes)."""

    rows: DataFrame
    root: str
    arity: int
    height: int
    top_height: int

    def proof(self) -> Column:
        """All siblings from the leaf to the root, as hex digests one behind the other."""
        return _hex(F.concat("proof", "top_proof"))

    def folded_root(self, leaf: Column) -> Column:
        """The root that a leaf (hex) leads to by the siblings of its row."""
        subroot = folded(leaf, F.col("proof"), F.col("idx"), F.col("n"), self.arity, self.height)
        return folded(subroot, F.col("top_proof"), F.col("top_idx"), F.col("top_n"), self.arity, self.top_height)


def manifest(docs: DataFrame, values: list[str], group: str, order: str, carry: dict[str, Column] | None = None, arity: int = 2) -> Manifest:
    """The manifest of a table: a leaf for each row, made of the columns `values`, in a tree for each value of `group`, ordered by `order`.

    Groups are ordered by their UTF-8 bytes, null first; within one, rows by `order`, null first, and rows of equal `order` by their leaf;
    repeated rows are each a leaf. `carry` names Columns over `docs` that the rows keep. An empty table has no root: its manifest has no rows and
    an empty text as root. Two numbers for each level and one digest reach the driver.
    """
    if arity < 2:
        raise ValueError("a run has two nodes at least")
    spark = docs.sparkSession
    store = Store(spark, f"{checkpoint_dir(spark).rstrip('/')}/manifest-{uuid.uuid4().hex}")
    carry = carry or {}
    own = docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0")).alias("__group"), F.col(f"`{order}`").alias("__order"),
        F.unhex(leaf_digest([F.col(f"`{v}`") for v in values])).alias("digest"), F.struct(F.lit(0).alias("__"), *[c.alias(name) for name, c in carry.items()]).alias("kept"),
    )
    rows, sizes = numbered(own, "__group", ["__order", "digest"], store, "rows")
    trees, _ = numbered(sizes.withColumn("tree_of_all", F.lit(0)), "tree_of_all", ["__group"], store, "trees")
    trees = store.put(trees.select("__group", "n", F.col("idx").alias("tree")), "trees-numbered")
    n_rows, n_trees, most = trees.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    height, top_height = _height(most, arity), _height(n_trees, arity)
    nodes = looked_up(rows, trees, ["__group"], n_trees).select("tree", "idx", "n", "digest", "kept")
    below = forest(nodes, n_rows, n_trees, height, arity, store, "rows")
    roots = below.roots().select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n_trees).cast("long").alias("n"), "digest")
    above = forest(roots, n_trees, 1, top_height, arity, store, "groups")
    root = above.roots().select(_hex(F.col("digest"))).first()
    top = store.put(above.proofs(store, "groups").select(F.col("idx").alias("tree"), _hex(F.col("digest")).alias("subroot"), F.col("idx").alias("top_idx"), F.col("n").alias("top_n"), F.col("proof").alias("top_proof")), "groups")
    out = looked_up(below.proofs(store, "rows"), top, ["tree"], n_trees)
    kept = [F.col("kept")[name].alias(name) for name in carry]
    out = out.select(*kept, _hex(F.col("digest")).alias("leaf"), "subroot", "idx", "n", "proof", "top_idx", "top_n", "top_proof")
    return Manifest(out, root[0] if root else "", arity, height, top_height)
