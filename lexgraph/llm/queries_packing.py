"""Queries of problem 9: documents in containers of 2,048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table
from . import bpe
from .packing import fill_report, pack


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(bpe.count_tokens(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "n_tokens"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p9_containers(spark, d))


QUERIES = {"p9_containers": p9_containers, "p9_fill": p9_fill}
ORACLE: dict = {}
