"""Queries of problem 1: oversized texts of nodes and spans in pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table
from .split import split_oversized


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    nodes = split_oversized(table(spark, d, "node"), "node", "id", "text", "loaded_at")
    return nodes.unionByName(split_oversized(table(spark, d, "source_span"), "source_span", "span_id", "raw_text", "loaded_at"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The items that came out in more than one piece: of each, its second piece."""
    return p1_pieces(spark, d).where("piece_no = 2").select("item_table", "item_id")


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}
ORACLE = {
    "p1_found": "select distinct 'node' item_table, id item_id from node where length(text) > 1800 union select distinct 'source_span', span_id from source_span where length(raw_text) > 1800"
}
