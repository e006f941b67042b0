"""Scans of nodes and chunks: which rows, in what order, one of several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def most_specific(labels: Column, order: list[str]) -> Column:
    """The first of ``order`` among a node's labels; null if it has none of them."""
    return F.get(F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains(labels, x)), F.lit(0))


def labelled(nodes: DataFrame, order: list[str], generic: Column) -> DataFrame:
    """(node_id, label, name) of nodes with a label of ``order`` that are not ``generic``; a missing name is the canonical one.

    A null ``generic`` says nothing.  Sorted by label and name.
    """
    n = nodes.withColumn("label", most_specific(F.col("labels"), order)).filter(F.col("label").isNotNull() & ~F.coalesce(generic, F.lit(False)))
    return n.select("node_id", "label", F.coalesce("name", "canonical_name").alias("name")).orderBy("label", "name", "node_id")


def first_chunk(mentions: DataFrame, chunks: DataFrame, value: str = "text", order: str = "sequence") -> DataFrame:
    """(node_id, value): of each node's chunks the first by ``order`` (ties by chunk)."""
    both = mentions.select("node_id", "chunk_id").join(chunks.select("chunk_id", order, value), "chunk_id")
    return both.groupBy("node_id").agg(F.min_by(value, F.struct(order, "chunk_id")).alias(value))


def on_dates(chunks: DataFrame, dates: DataFrame) -> DataFrame:
    """Chunks of the wanted dates, by one join for all of them."""
    return chunks.join(dates.select("date").distinct(), "date", "left_semi")


def sample(rows: DataFrame, most: int, order: list[str], seed: int = 0) -> DataFrame:
    """At most ``most`` rows picked by chance (the same for a seed), sorted by ``order``."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *rows.columns), *rows.columns).limit(most).orderBy(*order)


def first_of_each(rows: DataFrame, key: str, order: list[str], when: Column) -> DataFrame:
    """The first row by ``order`` of each ``key`` among those where ``when`` holds."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.filter(when).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def checked_labels(wanted: list[str], known: list[str]) -> list[str]:
    """``wanted``, or all if there are none; an unknown label is an error."""
    unknown = sorted(set(wanted) - set(known))
    if unknown:
        raise ValueError(f"unknown labels: {', '.join(unknown)}")
    return list(wanted or known)
