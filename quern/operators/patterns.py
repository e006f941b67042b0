"""Graph patterns as joins. An edge table has ``src``, ``dst`` and often ``rel_type``, ``date`` and ``chunk_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of_type(edges: DataFrame, *types: str) -> DataFrame:
    """Edges of any of the types; pushed down to the scan, or to partitions where ``rel_type`` is one."""
    return edges.filter(F.col("rel_type").isin(*types))


def hop(sources: DataFrame, edges: DataFrame, targets: DataFrame | None = None, source_id: str = "node_id", target_id: str = "node_id", prefix: str = "dst_") -> DataFrame:
    """``(a)-[e]->(b)``: the sources' columns with each edge's, and the targets' under ``prefix``."""
    out = sources.join(edges, F.col(source_id) == F.col("src"))
    if targets is not None:
        named = targets.select(*[F.col(c).alias(prefix + c) for c in targets.columns])
        out = out.join(named, F.col("dst") == F.col(prefix + target_id))
    return out


def distinct_targets(edges: DataFrame, *keep: str) -> DataFrame:
    return edges.select(*(keep or ("dst",))).distinct()


def co_mentioned(left: DataFrame, right: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """Pairs of rows of two mention tables that share a chunk."""
    return left.join(right, chunk)


def having(df: DataFrame, pattern: DataFrame, on: list[str] | str) -> DataFrame:
    """EXISTS { pattern }."""
    return df.join(pattern, on, "left_semi")


def lacking(df: DataFrame, pattern: DataFrame, on: list[str] | str) -> DataFrame:
    """NOT EXISTS { pattern }; a null key has no pattern, so it stays."""
    return df.join(pattern, on, "left_anti")


def optional(df: DataFrame, pattern: DataFrame, on: list[str] | str, where: Column | None = None) -> DataFrame:
    """OPTIONAL MATCH … WHERE: the condition belongs to the pattern, rows without a match keep nulls."""
    return df.join(pattern.filter(where) if where is not None else pattern, on, "left")


def among(edges: DataFrame, ids: DataFrame, column: str = "node_id") -> DataFrame:
    """Edges of which both ends are in a set."""
    s = ids.select(F.col(column)).distinct()
    return edges.join(s.select(F.col(column).alias("src")), "src", "left_semi").join(s.select(F.col(column).alias("dst")), "dst", "left_semi")


def first_mention(edges: DataFrame, *by: str) -> DataFrame:
    """(*by, first_date): the earliest date of each key, or of all rows."""
    return edges.groupBy(*by).agg(F.min("date").alias("first_date"))


def dated(edges: DataFrame, anchor: DataFrame, lower: str | None = None, upper: str | None = None, strict: bool = True) -> DataFrame:
    """Edges whose date lies between two SQL expressions over the columns of ``anchor``, a table of one row.

    ``lower`` and ``upper`` are compared with < (``strict``) or <=; either may be left out.  No anchor, no rows.
    """
    less = (lambda a, b: a < b) if strict else (lambda a, b: a <= b)
    # one row by contract: the aggregate that makes it has no keys
    both = edges.crossJoin(F.broadcast(anchor.limit(1)))
    if lower:
        both = both.filter(less(F.expr(lower), F.col("date")))
    if upper:
        both = both.filter(less(F.col("date"), F.expr(upper)))
    return both.select(*edges.columns)
