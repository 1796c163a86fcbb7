"""Connected components of a graph whose nodes may have any degree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlane.session import cut


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``node, component`` of every node of ``edges`` (columns ``a``, ``b``); the component is its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): the number of rounds grows with the
    logarithm of the size, whatever the diameter. A round is two minima with partial aggregation and two joins on
    the node, which adaptive execution splits where one node has very many neighbours; nothing is gathered. Each
    round ends in a reliable checkpoint. Null ends, loops and repeated edges are dropped; a node that has only
    loops isn't in the result.
    """
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u is not null and v is not null and u != v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        # large star: every neighbour above u is hung on the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: u and its neighbours below are hung on the smallest of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        hung = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def forest_roots(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``node, root`` of every node of a forest given as ``node, up`` (one row a node that isn't a root).

    Pointer doubling: each round hangs a node on the one above its upper node, so a chain of a million links takes 20
    rounds. A node whose upper node is a root is settled and leaves; the rest look up the pointers of the round before. Roots
    themselves, and nodes without link, aren't in the result. Cycles raise; null ends and loops are dropped.
    """
    pointers = cut(links.where("node is not null and up is not null and node != up").select("node", "up"))
    settled, open_ = [], pointers
    for _ in range(max_rounds):
        above = pointers.select(F.col("node").alias("up"), F.col("up").alias("further"))
        step = cut(open_.join(above, "up", "left").select("node", "up", "further"))
        settled.append(step.where("further is null").select("node", F.col("up").alias("root")))
        open_ = step.where("further is not null").select("node", F.col("further").alias("up"))
        if open_.isEmpty():
            break
        pointers = open_
        for s in settled:
            pointers = pointers.unionByName(s.select("node", F.col("root").alias("up")))
    else:
        raise RuntimeError(f"the links aren't a forest, or deeper than 2^{max_rounds}")
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out
