"""Cutting lineage in the folder all executors share.

``spark.checkpoint.dir`` names that folder.  Where neither the session nor its context has one, a folder under
``/tmp/checkpoints`` is used on a local master alone (unit tests); on a cluster that is an error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or f"file:///tmp/checkpoints/{uuid.uuid4().hex}")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably; later plans start from the stored rows, also after executors are lost.

    Nothing reads the shuffles again that led to the stored rows, so their files go at once, not when the driver happens to
    collect its garbage: a chain of cuts needs the disk of one.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan takes the setting as it is made
    finally:
        if was is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, was)
