"""Exact vector search by cosine, in built-in functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either is null or of length 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def scored(vectors: DataFrame, query: list[float], vector: str = "embedding", out: str = "score") -> DataFrame:
    """Cosine with one query vector, which is normalised here once."""
    norm = math.sqrt(sum(x * x for x in query))
    unit = F.array(*[F.lit(x / norm if norm else 0.0) for x in query])
    v = F.col(vector)
    length = F.sqrt(dot(v, v))
    return vectors.withColumn(out, F.when(length > 0, dot(v, unit) / length))


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector: str = "embedding", decimals: int = 6) -> DataFrame:
    """The ``k`` nearest, ties by id: one pass, each task keeps ``k`` rows. Rows without a score are left out."""
    s = scored(vectors, query, vector).withColumn("score", F.round("score", decimals)).filter("score is not null")
    return s.orderBy(F.desc("score"), id_col).limit(k)


def top_per_label(vectors: DataFrame, query: list[float], label: str = "label", id_col: str = "vec_id", vector: str = "embedding", keep: Column | None = None, decimals: int = 6) -> DataFrame:
    """The nearest of each label; ``keep`` filters **after** it is chosen, so a label may be left without any."""
    s = scored(vectors, query, vector).withColumn("score", F.round("score", decimals)).filter("score is not null")
    best = s.groupBy(label).agg(F.max_by(F.struct(*[F.col(c) for c in s.columns]), F.struct(F.col("score"), -F.col(id_col))).alias("b")).select("b.*")
    return best.filter(keep) if keep is not None else best


def embedded(texts: DataFrame, id_col: str, text: Column, dim: int = 64) -> DataFrame:
    """(id, embedding): counts of tokens in ``dim`` buckets, of length one; the embedder without a model, for a whole column.

    Tokens are lower-cased runs of letters and digits of any script.  A text without one has zeros, a null text null.
    """
    rows = texts.select(F.col(id_col).alias("id"), text.alias("_t"))
    token = F.explode(F.regexp_extract_all(F.lower("_t"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    bucket = F.conv(F.substring(F.md5(F.col("token")), 1, 8), 16, 10).cast("bigint") % dim
    n = rows.select("id", token.alias("token")).groupBy("id", bucket.cast("int").alias("b")).agg(F.count("*").alias("n"))
    v = n.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    value = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i) / F.col("norm"), F.lit(0.0)))
    zeros = F.array_repeat(F.lit(0.0), dim)
    return rows.select("id", F.col("_t").isNull().alias("_null")).join(v, "id", "left").select("id", F.when(F.col("_null"), None).when(F.col("m").isNull(), zeros).otherwise(value).alias("embedding"))
