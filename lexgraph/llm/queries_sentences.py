"""Queries of problem 10: sentence units of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .sentences import sentence_units


def p10_units(spark: SparkSession, d: str) -> DataFrame:
    return sentence_units(table(spark, d, "documents").select("doc_id", "text"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_units(spark, d).select("doc_id", F.col("end_char").cast("long").alias("end_char"))


QUERIES = {"p10_found": p10_found, "p10_units": p10_units}
ORACLE: dict = {}
