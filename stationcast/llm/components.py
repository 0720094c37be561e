"""Connected components of a link table, by alternating star contractions.

Every round is two groupings and two joins on the link table alone. A node with very
many links is a large key of an inner join, which Spark splits at run time; its smallest
neighbour is found by a partial aggregate, so its links are never gathered. The number
of rounds grows with the logarithm of the longest chain of links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationcast.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node are linked to the smallest of node and neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.filter("b > a").join(least, "a")
    return joined.select(F.col("m").alias("a"), "b").filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a"))
    least = down.groupBy("b").agg(F.min("a").alias("m"))
    joined = down.join(least, "b")
    linked = joined.select(F.col("m").alias("p"), F.col("a").alias("q"))
    own = least.select(F.col("m").alias("p"), F.col("b").alias("q"))
    return linked.unionByName(own).filter("p <> q").distinct().select(F.col("p").alias("a"), F.col("q").alias("b"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for all nodes of ``links`` (columns ``a, b``), root being the smallest reachable.

    Null ends and links of a node to itself are ignored. Nodes without links do not
    appear: they are their own root.
    """
    edges = stage(links.select("a", "b").filter("a is not null and b is not null and a <> b").distinct(), "links")
    before: tuple | None = None
    for _ in range(most_rounds):
        edges = stage(_small_star(_large_star(edges)), "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = tuple(state)
    raise RuntimeError("components did not settle")
