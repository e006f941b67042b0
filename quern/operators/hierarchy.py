"""Transitive queries over (child, parent) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.lineage import cut


def closure(parents: DataFrame, child: str = "child", parent: str = "parent", depth: int | None = None) -> DataFrame:
    """(node, ancestor, depth): the shortest path to every ancestor, in rounds until none is new; ``depth`` bounds the rounds.

    Each round joins the pairs of the last one alone with the parents.  On a cycle a node is its own ancestor, too.
    """
    step = cut(parents.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).dropna().distinct())
    up = step.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_up"))
    every = last = step.withColumn("depth", F.lit(1))
    d = 1
    while depth is None or d < depth:
        d += 1
        new = last.join(up, "ancestor").select("node", F.col("_up").alias("ancestor")).distinct().join(every.select("node", "ancestor"), ["node", "ancestor"], "left_anti")
        last = cut(new.withColumn("depth", F.lit(d)))
        if last.isEmpty():
            break
        every = every.unionByName(last)
    return every


def closure_recursive(parents: DataFrame, child: str = "child", parent: str = "parent", view: str = "_closure_parents") -> DataFrame:
    """The same in one recursive statement, for trees within the session's limits of levels and rows; ``closure`` has none."""
    parents.select(F.col(child).alias("c"), F.col(parent).alias("p")).dropna().distinct().createOrReplaceTempView(view)
    return parents.sparkSession.sql(
        f"WITH RECURSIVE up(node, ancestor, depth) AS (SELECT c, p, 1 FROM {view} UNION ALL SELECT up.node, v.p, up.depth + 1 FROM up JOIN {view} v ON v.c = up.ancestor) "
        "SELECT node, ancestor, min(depth) AS depth FROM up GROUP BY node, ancestor"
    )


def rank_chain(ranks: list[tuple[str, Column]]) -> Column:
    """array<struct<rank, name>> of the ranks that are present, most general first; gaps are skipped."""
    every = F.array(*[F.struct(F.lit(r).alias("rank"), c.alias("name")) for r, c in ranks])
    return F.filter(every, lambda x: x.getField("name").isNotNull())


def chain_edges(df: DataFrame, key: str, chain: Column) -> DataFrame:
    """(key, rank, name, parent_rank, parent_name): consecutive present ranks; the most general has no parent."""
    pos = F.posexplode("_c")
    out = df.select(F.col(key), chain.alias("_c")).select(key, "_c", pos.alias("_i", "_x"))
    up = F.get("_c", F.col("_i") - 1)
    return out.select(key, "_x.rank", "_x.name", up.getField("rank").alias("parent_rank"), up.getField("name").alias("parent_name"))


def alias_rollup(closed: DataFrame, aliases: DataFrame, least: int = 2) -> DataFrame:
    """(ancestor, aliases): the sorted set of trimmed aliases, of ``least`` characters at least, of all descendants."""
    words = aliases.select("node", F.trim("alias").alias("alias")).filter(F.length("alias") >= least)
    return closed.join(words, "node").groupBy("ancestor").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
