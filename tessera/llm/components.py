"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import checkpoint, looked_up

#: Edges of a node from which it is a hub.
HUB = 256


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame) -> DataFrame:
    """`edges` with m, the smallest v of each u. A u with over HUB rows is looked up where its rows are, so that the centre of a large
    star is no task of its own; there are at most a HUBth as many such nodes as edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = checkpoint(least.where(F.col("n") > HUB).select("u", F.col("m").alias("hub_m")))
    n = hubs.count()
    plain = least.where(F.col("n") <= HUB).select("u", "m")
    if not n:
        return edges.join(plain, "u")
    seen = looked_up(edges, hubs, ["u"], n)
    rest = seen.where("hub_m IS NULL").drop("hub_m").join(plain, "u")
    return seen.where("hub_m IS NOT NULL").select("u", "v", F.col("hub_m").alias("m")).union(rest.select("u", "v", "m"))


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link to another one; component is the smallest node it can reach.

    links: pairs of longs in any direction; repeated links and links of a node with itself do no harm, rows with a null are
    left out. Large-star links the larger neighbours of a node to its smallest neighbour, small-star the smaller ones; when a
    round changes nothing, every node is linked to its component alone. Only a few numbers a round reach the driver.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    edges = checkpoint(edges)
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("v", "u"))
        large = _with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = checkpoint(large)
        down = _with_least(large)
        # every node goes to its smallest one, and so do the other smaller ones
        small = down.select("u", F.col("m").alias("v")).union(down.select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = checkpoint(small.where(F.col("u") != F.col("v")).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
