"""Dealing out rows in tasks whose size does not grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS = 400_000


def dealt(rows: int, *tables: DataFrame, by: list[str]) -> list[DataFrame]:
    """``tables`` dealt out by ``by``, alike, so that a task gets about ``ROWS`` of ``rows``.

    Left to itself, Spark makes as few tasks as there are cores until they have 64 MB of packed rows each, so what a task sorts
    or hashes grows with the input.  Inputs that give the cores no more than that anyway are left alone.
    """
    n = -(-rows // ROWS)
    return [t.repartition(n, *by) for t in tables] if n > tables[0].sparkSession.sparkContext.defaultParallelism else list(tables)
