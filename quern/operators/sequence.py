"""The chain of chunks as numbers: traversal along it is arithmetic, so bounded paths become equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.lineage import cut


def with_sequence(df: DataFrame, order: list[Column], name: str = "sequence") -> DataFrame:
    """Rows numbered from 0 in ``order`` (which should be total), without a task that holds them all.

    Ranges are stored, each counts its rows, and a prefix sum over the ranges' counts gives their offsets.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_n", own).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_first") + F.col("_n") - 1).drop("_part", "_n", "_first")


def next_edges(chunks: DataFrame, chunk_id: str = "chunk_id", sequence: str = "sequence") -> DataFrame:
    """(src, dst) of consecutive chunks, by an equi-join on the number."""
    a = chunks.select(F.col(chunk_id).alias("src"), (F.col(sequence) + 1).alias("_n"))
    b = chunks.select(F.col(chunk_id).alias("dst"), F.col(sequence).alias("_n"))
    return a.join(b, "_n").drop("_n")


def around(chunks: DataFrame, anchors: DataFrame, back: int, ahead: int, anchor: str = "anchor", sequence: str = "sequence", zero: bool = True) -> DataFrame:
    """Chunks from ``back`` before to ``ahead`` after each anchor: bounded paths along the chain, either way.

    ``anchors`` is (anchor, sequence).  Each anchor explodes into the few numbers wanted, then an equi-join.
    """
    steps = F.explode(F.sequence(F.col(sequence) - back, F.col(sequence) + ahead))
    wanted = anchors.select(F.col(anchor), F.col(sequence).alias("_at"), steps.alias(sequence))
    out = wanted.join(chunks, sequence).withColumn("distance", F.col(sequence) - F.col("_at")).drop("_at")
    return out if zero else out.filter("distance <> 0")


def preceding(chunks: DataFrame, anchors: DataFrame, k: int, anchor: str = "anchor", sequence: str = "sequence") -> DataFrame:
    return around(chunks, anchors, k, -1, anchor, sequence)
