"""Queries of problem 6: noise of scanned pages in texts of nodes and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .scanned import corpus_counts, repair_scanned


def _items(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "node").select(F.lit("node").alias("item_table"), F.col("id").alias("item_id"), "loaded_at", "text")
    spans = table(spark, d, "source_span").select(F.lit("source_span").alias("item_table"), F.col("span_id").alias("item_id"), "loaded_at", F.col("raw_text").alias("text"))
    return nodes.unionByName(spans).where(F.length("text") > 0)


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every delivered text with its repair: item_table, item_id, loaded_at, repaired, traces."""
    items = _items(spark, d)
    return repair_scanned(items, corpus_counts(items)).drop("text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    found = repair_scanned(items.select("item_table", "item_id", "text"), corpus_counts(items), with_text=False)
    return found.where("traces > 0").select("item_table", "item_id").distinct()


QUERIES = {"p6_found": p6_found, "p6_repaired": p6_repaired}
ORACLE: dict = {}
