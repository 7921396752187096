"""Connected components of a link table, by alternating large-star and small-star rounds.

Defined results: repeated links, links both ways and links of a node with itself count once or not at all; a link with a
null end is none. Nodes without a link to another one aren't returned. Other columns don't matter. An empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.storage import cut


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.v", "e.w")


def large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of v is linked to the smallest of v and its neighbours."""
    near = both_ways(edges)
    # Written, so that the join can split a node with very many neighbours.
    least = cut(near.groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("m")), "least")
    return near.filter("w > v").join(least, "v").select(F.col("w").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """v and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w")).filter("v <> w")
    least = cut(down.groupBy("v").agg(F.min("w").alias("m")), "least")
    moved = down.join(least, "v")
    out = moved.select(F.col("w").alias("a"), F.col("m").alias("b")).filter("a <> b").union(moved.select(F.col("v").alias("a"), F.col("m").alias("b")))
    return out.distinct()


def mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round is written to the shared folder. Rounds end when the links no longer change, which takes about the
    logarithm of the longest path; links are then stars around each component's smallest node.
    """
    links = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = mark(links)
    for _ in range(max_rounds):
        if not before[0]:
            break
        links = cut(small_star(large_star(links)), "links")
        after = mark(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
