"""Schemas of the graph's tables, and the checks that stand in for a store's uniqueness constraints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DateType()
CHUNKS = T.StructType([T.StructField("chunk_id", _S), T.StructField("text", _S), T.StructField("author", _S), T.StructField("date", _D), T.StructField("sequence", _L), T.StructField("token_count", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
NODES = T.StructType([T.StructField("node_id", _L), T.StructField("label", _S), T.StructField("labels", T.ArrayType(_S)), T.StructField("canonical_name", _S), T.StructField("name", _S), T.StructField("aliases", T.ArrayType(_S)), T.StructField("flag", T.BooleanType()), T.StructField("is_generic", T.BooleanType()), T.StructField("description", _S), T.StructField("embedding", T.ArrayType(T.FloatType()))])
EDGES = T.StructType([T.StructField("src", _L), T.StructField("rel_type", _S), T.StructField("dst", _L), T.StructField("date", _D), T.StructField("chunk_id", _S)])
MENTIONS = T.StructType([T.StructField("node_id", _L), T.StructField("chunk_id", _S)])
TAXA = T.StructType([T.StructField("taxon_id", _L), T.StructField("rank", _S), T.StructField("name", _S), T.StructField("ext_key", _L), T.StructField("parent_id", _L)])
REL_SCHEMA = T.StructType([T.StructField("rel_type", _S), T.StructField("src_labels", T.ArrayType(_S)), T.StructField("dst_labels", T.ArrayType(_S))])
EXTRACTION = T.StructType([
    T.StructField("nodes", T.ArrayType(T.StructType([T.StructField("id", _S), T.StructField("label", _S), T.StructField("name", _S), T.StructField("canonicalName", _S)]))),
    T.StructField("relationships", T.ArrayType(T.StructType([T.StructField("start_node_id", _S), T.StructField("end_node_id", _S), T.StructField("type", _S)]))),
])


@dataclass(frozen=True)
class GraphState:
    """The tables that a step of a build takes and gives."""

    nodes: DataFrame
    edges: DataFrame
    mentions: DataFrame
    chunks: DataFrame


def violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, n) of keys that occur more than once; empty if ``keys`` is unique. Null keys count like others."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
