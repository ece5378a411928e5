"""Connected components of links, by rounds of joins (large star, small star).

Each round moves links towards the smallest node that either end knows; the rounds end when
every link leads to the smallest node of its component. Rounds are stored in the shared
folder, so that a lost executor costs no more than one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castline.llm.common import discard, stored


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node that it reaches.

    Nodes are of any type that has an order. Null ends and links of a node to itself are left
    out; links may be repeated and go either way; no links give no rows.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(high.alias("a"), low.alias("b")).distinct()
    edges, mark = _round(edges)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        # Large star: larger neighbours go to the smallest node around.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = edges.groupBy("a").agg(F.min("b").alias("m")).unionByName(edges.groupBy("b").agg(F.min("b").alias("m")).withColumnRenamed("b", "a"))
        least = least.groupBy("a").agg(F.min("m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # Small star: smaller neighbours, and the node itself, go to the smallest of them.
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        before, (edges, new) = edges, _round(small)
        discard(before)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _round(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The stored edges, with their number and a sum of hashes that tells whether they changed."""
    kept = stored(edges, "links")
    row = kept.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return kept, (row[0], row[1])
