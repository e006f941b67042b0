from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.labelled import remainder
from quern.llm.langid import fit, identify, training_rows


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fold = remainder("doc_id", 5)
    model = fit(training_rows(docs, fold != 0), docs)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))


QUERIES = {"op2_language_id": op2_language_id}
SQL: dict[str, str] = {}
