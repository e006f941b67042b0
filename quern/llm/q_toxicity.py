from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.labelled import remainder
from quern.llm.toxicity import fit, judge


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fold = remainder("doc_id", 5)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold != 0).select("doc_id", "toxic").dropna()
    out = judge(docs, fit(labels, docs))
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
SQL: dict[str, str] = {}
