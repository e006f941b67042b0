"""Streams: entries to chunks with upserts, and windows over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions.chunking import pack_text, token_count


def chunk_stream(entries: DataFrame, most: int = 500, separator: str = r"\n\s*\n", joiner: str = "\n\n") -> DataFrame:
    """(entry_no, author, date, segment, text, token_count) of a stream of entries; stateless."""
    return entries.filter("body is not null").select("entry_no", "author", "date", F.posexplode(pack_text(F.col("body"), most, separator, joiner)).alias("segment", "text")).withColumn("token_count", token_count(F.col("text")))


def upsert_stream(chunks: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Each batch's rows are appended under its number; a batch run again replaces its own (exactly once).

    ``latest`` gives the upserted view.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame, keys: list[str], version: str = "batch") -> DataFrame:
    """The row of each key's last batch."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("v")).select(*keys, "v.*")


def windowed(events: DataFrame, time: str, late: str, length: str, slide: str | None, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates over tumbling or sliding windows, with rows later than ``late`` left out once their window is closed."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(*aggregates).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *[a for a in _names(aggregates)])


def sessions(events: DataFrame, time: str, late: str, gap: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    s = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(s, *keys).agg(*aggregates).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, *_names(aggregates))


def _names(aggregates: list[Column]) -> list[str]:
    return [a._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for a in aggregates]
