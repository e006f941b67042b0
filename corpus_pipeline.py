"""The corpus pipeline: language ID, near-duplicates, repeated passages, benchmark passages, piece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs; all
but the last return the columns of documents.  Every stage works on all rows that its predecessor kept.  An empty table
stays empty, further columns pass through whatever their names (a stage's own column takes a name that is free).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, langid, neardup, pieces, substring
from quern.llm.q_pieces import MODEL
from quern.operators.lineage import ensure_checkpoint_dir


def _free(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts, texts without a letter and those whose language the calibrated model rejects; learns from ``docs`` themselves."""
    model = langid.fit(langid.training_rows(docs, F.lit(True)), docs)
    own = _free(docs, "_language")
    return langid.identify(docs, model, out=own).filter(~F.col(f"{own}.rejected")).drop(own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays: that with the smallest id.

    Of rows with one id the smallest by all columns stays, rows without an id all stay.
    """
    found = neardup.near_duplicates(docs.select("doc_id", "text"), width=5, percent=80).filter("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(found, "doc_id", "left_semi").select(*docs.columns)
    first = named.groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return first.unionByName(docs.filter("doc_id is null"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts; a text without any stays as it is, one of nothing else becomes empty."""
    own = _free(docs, "_dedup")
    out = substring.remove_repeats(docs, out=own)
    cut = F.col(f"{own}.n_removed") > 0
    out = out.withColumn("text", F.when(cut, F.col(f"{own}.kept")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(cut, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    own = _free(docs, "_bench")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, bench, out=own).filter(~F.col(f"{own}.contaminated")).drop(own)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with ``piece_ids``."""
    return pieces.encode(docs, pieces.load(MODEL))


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("substring_dedup", repeats), ("decontamination", benchmark), ("sentencepiece", encode)]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again; the last one's rows stay there."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if last:
            _delete(spark, last)
        last = f"{base}/{name}"
    return docs


#: The language model and the piece model have no SQL; tests hold the rest against brute force.
ORACLE_SQL = None
