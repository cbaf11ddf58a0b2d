"""Queries of problem 7: cached pages as clean text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table
from .markup import clean_markup, found_markups


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """One row per delivered page: id, loaded_at, clean_text, markups."""
    return clean_markup(table(spark, d, "document_source").select("id", "loaded_at", "raw_html")).drop("raw_html")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return found_markups(p7_clean(spark, d), "id").withColumnRenamed("id", "source_id").distinct()


QUERIES = {"p7_found": p7_found, "p7_clean": p7_clean}
ORACLE: dict = {}
