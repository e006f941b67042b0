"""Full-text lookup: an inverted index as a table, scored by BM25."""

from __future__ import annotations

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters, their marks and digits of any script.
WORD = r"[\p{L}\p{M}\p{N}]+"
ASCII = "[a-z0-9]+"


def tokens(text: Column, word: str = WORD) -> Column:
    """Lower-cased runs of letters and digits, by default of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(word), F.lit(0))


def index(docs: DataFrame, id_col: str, text: Column, word: str = WORD) -> DataFrame:
    """(id, token, tf, length); partial counts are taken before the shuffle."""
    t = docs.select(F.col(id_col).alias("id"), tokens(text, word).alias("t")).filter("id is not null and t is not null")
    return t.select("id", F.size("t").alias("length"), F.explode("t").alias("token")).groupBy("id", "token", "length").agg(F.count("*").alias("tf"))


def search(postings: DataFrame, query: str, n_docs: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, decimals: int = 6, word: str = WORD) -> DataFrame:
    """(id, score) of the ``k`` best by BM25, ties by id.

    ``n_docs`` is one row (n, mean_length).  Only postings of the query's few tokens are read on; ``word`` is the index's.
    """
    words = sorted(set(regex.findall(word, query.lower())))
    hit = postings.filter(F.col("token").isin(words)) if words else postings.limit(0)
    df = hit.groupBy("token").agg(F.count("*").alias("df"))  # as many rows as the query has tokens
    both = hit.join(F.broadcast(df), "token").crossJoin(F.broadcast(n_docs))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    return both.groupBy("id").agg(F.round(F.sum(part), decimals).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def corpus_size(docs: DataFrame, text: Column, word: str = WORD) -> DataFrame:
    t = docs.select(F.size(tokens(text, word)).alias("s")).filter("s >= 0")
    return t.agg(F.count("*").cast("double").alias("n"), F.avg("s").alias("mean_length"))


def store(docs: DataFrame, id_col: str, text: Column, path: str, word: str = WORD) -> None:
    """Writes the index once: postings in ranges of (token, id), so a search reads only row groups that hold its tokens.

    A frequent token spans several files.  What stands at ``path`` is replaced.
    """
    index(docs, id_col, text, word).repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.mode("overwrite").parquet(f"{path}/postings")
    corpus_size(docs, text, word).coalesce(1).write.mode("overwrite").parquet(f"{path}/size")


def stored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, n_docs) of a stored index, as ``search`` takes them."""
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/size")
