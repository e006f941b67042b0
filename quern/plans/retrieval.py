"""Assembling what a question needs: passages, their entities and relations, and the chain around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import passage
from quern.operators import patterns, sequence, vector


def chunk_entities(chunks: DataFrame, mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(chunk_id, entities): sorted distinct (label, name) of each chunk; one without any has one of null label and name ''."""
    named = mentions.join(nodes.select("node_id", "label", F.coalesce("canonical_name", "name", F.lit("")).alias("name")), "node_id").select("chunk_id", F.struct("label", "name").alias("e")).distinct()
    lists = named.groupBy("chunk_id").agg(F.array_sort(F.collect_list("e")).alias("entities"))
    blank = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.lit("").alias("name")))
    return chunks.select("chunk_id").distinct().join(lists, "chunk_id", "left").select("chunk_id", F.coalesce("entities", blank).alias("entities"))


def chunk_relations(chunks: DataFrame, mentions: DataFrame, edges: DataFrame, limit: int | None = 30) -> DataFrame:
    """(src, rel_type, dst) of which both ends are mentioned in the chunks; the first ``limit`` by type and ends."""
    ids = mentions.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    out = patterns.among(edges, ids).select("src", "rel_type", "dst").distinct()
    return out.orderBy("rel_type", "src", "dst").limit(limit) if limit else out


def sequence_context(chunks: DataFrame, anchors: DataFrame, back: int = 5, most: int = 8) -> DataFrame:
    """The earliest ``most`` of the chunks up to ``back`` before the anchors, by date, then number."""
    out = sequence.preceding(chunks, anchors, back).drop("anchor", "distance").distinct()
    return out.orderBy("date", "sequence").limit(most)


def vector_with_context(chunks: DataFrame, query: list[float], k: int = 8, anchors: int = 4, back: int = 4) -> DataFrame:
    """The ``k`` nearest chunks and what precedes the first ``anchors`` of them; a chunk found both ways counts as found."""
    found = vector.top_k(chunks, query, k, id_col="chunk_id").withColumn("retrieval", F.lit("vector"))
    first = found.orderBy(F.desc("score"), "chunk_id").limit(anchors).select(F.col("chunk_id").alias("anchor"), "sequence")
    before = sequence.preceding(chunks, first, back).select(*chunks.columns).distinct().join(found.select("chunk_id"), "chunk_id", "left_anti")
    return found.unionByName(before.withColumns({"score": F.lit(None).cast("double"), "retrieval": F.lit("sequence")}))


def value_enrichment(result: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes whose name any text cell of a result equals."""
    texts = [c for c, t in result.dtypes if t == "string"]
    if not texts:
        return nodes.limit(0)
    cells = result.select(F.explode(F.array(*texts)).alias("v")).dropna().select(F.upper("v").alias("v")).distinct()
    return nodes.join(cells, F.upper("canonical_name") == F.col("v"), "left_semi")


def context_text(sources: DataFrame, order: Column, separator: str = "\n\n---\n\n") -> DataFrame:
    """One row (context): passages in order."""
    p = F.struct(order.alias("o"), passage(F.col("author"), F.col("date"), F.col("text")).alias("p"))
    return sources.agg(F.array_join(F.transform(F.array_sort(F.collect_list(p)), lambda x: x["p"]), separator).alias("context"))  # the few passages of one answer


def deduplicated(records: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    from pyspark.sql import Window

    return records.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")
