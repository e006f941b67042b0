"""Reading tables, and the mapping of order data to a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.spread import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OBSERVED edges (src customer, dst part, supplier, date, chunk_id order): a multiset."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("src"), F.to_date("o_orderdate").alias("date"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("dst"), F.col("l_suppkey").alias("supplier"))
    o, li = dealt(li.count(), o, li, by=["chunk_id"])
    return o.join(li, "chunk_id").select("src", "dst", "supplier", "date", "chunk_id")


def mentions(spark: SparkSession, sf_dir: str, entity: str = "l_partkey") -> DataFrame:
    """MENTIONED_IN (node_id, chunk_id) of parts or suppliers in orders, without repeats."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col(entity).alias("node_id"), F.col("l_orderkey").alias("chunk_id")).distinct()


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent, rank, name) of the hierarchy customer -> nation -> region, names as keys."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("child"), F.col("n_name").alias("parent"), F.lit("nation").alias("rank"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"), F.lit("region").alias("rank"))
    return c.unionByName(n)


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A pre-built table."""
    return spark.read.parquet(path)


def run(spark: SparkSession, text: str, **params) -> DataFrame:
    """A query text with named parameters (``:name``)."""
    return spark.sql(text, args=params)


def ndjson(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
