"""Connected components over an edge table of any size, without collecting it.

Alternating star contraction (Kiveris et al., "Connected components in MapReduce and beyond", 2014): every node of an
edge table hands its larger neighbours to the smallest node it knows (large star), then its smaller ones (small star), until
the table is a forest of stars around the smallest nodes.  Rounds grow with the logarithm of the nodes, and each moves no
more edges than there were.  The smallest neighbour is a partial aggregate joined back, so a hub is split like any hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.lineage import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b), a > b, after one star step."""
    if large:
        near = edges.union(edges.select("b", "a"))  # all neighbours b of a
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        both = edges.join(least, "a")
        moved = both.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select("a", "m"))
    return moved.distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that occurs in ``edges``.

    Null ends are ignored, self loops make a node of one, repeated edges change nothing, no edges give no rows.
    """
    given = edges.select(F.col(src).alias("x"), F.col(dst).alias("y")).dropna()
    alone = given.filter("x = y").select(F.col("x").alias("a")).distinct()
    now = cut(given.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    was = _state(now)
    for _ in range(max_rounds):
        if not was[0]:
            break
        now = cut(_star(_star(now, large=True), large=False))
        is_ = _state(now)
        if is_ == was:
            break
        was = is_
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).union(alone.select("a")).distinct().join(now.select(F.col("a").alias("node")), "node", "left_anti")
    return cut(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component"))))
