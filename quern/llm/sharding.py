"""Contiguous shards of equal bytes, with DataFrame functions alone.

The rows' keys and sizes (never the texts) are ranged by key and stored; per-partition totals, a table as long as the
number of partitions, become global offsets by a prefix sum; each partition then sums within itself and cuts at the
equal targets ``total * s / shards``.  No task sees more than its range, and a repeated key is split by a salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.lineage import cut


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus one; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, *keep) for each row.

    Rows are ordered by id, size and checksum (null ids first; rows equal in all three are interchangeable).  A row goes
    to the shard in which the middle of its bytes falls, so shards differ from the target by one row at most and are
    contiguous; ``slot`` counts from 0 within a shard.  A null or empty text has size 1 and checksum 0.  An empty table
    gives no rows; fewer rows than shards leave shards empty.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_salt"), *[F.col(c) for c in keep or []],
    )
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "size", "text_crc32", "_salt")]
    # ranged rows keep their place once stored: what follows reads one and the same partitioning
    ranged = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte0"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0"), F.sum("_bytes").over(whole).alias("_total"),
    )
    own = Window.partitionBy("_part").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row for each partition: bounded by the number of partitions, not by the rows
    placed = ranged.withColumn("_end", F.sum("size").over(upto)).withColumn("_n", F.row_number().over(own)).join(F.broadcast(offsets), "_part")
    # the middle of a row's bytes, doubled to stay whole: (2 * end - size) / (2 * total) of the way
    placed = placed.withColumn("shard", F.expr(f"cast(least({shards - 1}, ((2 * (_byte0 + _end) - size) * {shards}) div (2 * _total)) as int)"))
    placed = placed.withColumn("_row", F.col("_row0") + F.col("_n") - 1)
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # as many rows as shards
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot"), *(keep or []))
