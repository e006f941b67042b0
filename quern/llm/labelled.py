"""Bounded, reproducible samples of labelled texts, and the splits that keep held-out rows out of training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.lineage import cut


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def bounded_sample(marks: DataFrame, docs: DataFrame, per_label: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, text): up to ``per_label`` ids of each label, picked by a hash of the id, with their whole texts.

    ``marks`` is (id, label); ids with a null id or label are left out.  An id with several rows or labels gives one row,
    with its smallest text and label.  Only ids and labels are ranked; texts are read for the picked ids alone.
    """
    one = marks.select(F.col(marks.columns[0]).alias("id"), F.col(marks.columns[1]).alias("label")).dropna().groupBy("id").agg(F.min("label").alias("label"))
    # a common label must not meet in one task: all but about twice the sample goes by the hash alone, before the shuffle
    one = cut(one.withColumn("h", F.xxhash64("id")))
    counts = one.groupBy("label").agg(F.count("*").alias("n"))  # one row for each label
    share = (2.0 * per_label + 200) / F.col("n")
    near = one.join(F.broadcast(counts), "label").filter(F.pmod("h", F.lit(1 << 30)) < F.least(share, F.lit(1.0)) * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "id"))
    picked = cut(near.withColumn("r", rank).filter(F.col("r") <= per_label).select("id", "label"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna()
    # bounded: per_label rows of two values for each label
    return texts.join(F.broadcast(picked), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
