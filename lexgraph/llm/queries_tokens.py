"""Queries of problem 8: token ids of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table
from . import bpe


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts again from their ids: what goes in comes out, empty for a null text."""
    return bpe.decode(p8_ids(spark, d)).select("doc_id", "text")


QUERIES = {"p8_ids": p8_ids, "p8_decoded": p8_decoded}
ORACLE = {"p8_decoded": "select doc_id, coalesce(text, '') as text from documents"}
