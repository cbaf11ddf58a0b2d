"""Paged listings, substring search and ranked full-text search."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import contains_any
from ..runtime import cut

K1, B = 1.2, 0.75


def clamp(limit: int, cap: int, least: int = 1) -> int:
    return max(least, min(limit, cap))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, cap: int = 1000) -> DataFrame:
    """One page in a total order; planned as a distributed top-k."""
    return df.orderBy(*order).offset(max(0, offset)).limit(clamp(limit, cap))


def table_rows(df: DataFrame, q: str | None = None) -> DataFrame:
    """Rows in which any string column contains q."""
    strings = [F.col(f.name) for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.where(contains_any(strings, q)) if q and strings else df


def merged_page(parts: list[DataFrame], order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page over several sources; each gives no more rows than the page can need."""
    heads = [p.orderBy(*order).limit(limit + offset) for p in parts]
    return reduce(lambda a, b: a.unionByName(b), heads).orderBy(*order).offset(offset).limit(limit)


def tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _equals(word: str):
    return lambda t: t == word


def bm25(df: DataFrame, q: str, key: str = "id", title: str = "title", text: str = "text") -> DataFrame:
    """key, score for the rows that hold all words of q, the lower the better.

    Score: minus the sum over the words of idf * f (k1 + 1) / (f + k1 (1 - b + b D / avg D)), idf at least 1e-6; a title that
    contains q as a whole comes before all. Texts are tokenised once: their lengths and the counts of the words are
    kept in a table that serves the statistics and the scores; nothing is shuffled but one row per task.
    """
    words = sorted({w for w in re.split(r"[\W_]+", q.lower()) if w})
    docs = df.where(F.length(F.trim(F.concat(F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(text), F.lit(""))))) > 0)
    docs = docs.select(F.col(key), F.col(title).alias("_title"), tokens(F.concat_ws(" ", F.col(title), F.col(text))).alias("_t"))
    whole = F.contains(F.lower(F.coalesce(F.col("_title"), F.lit(""))), F.lit(q.lower()))
    docs = docs.select(key, whole.alias("_whole"), F.size("_t").alias("_d"), *(F.size(F.filter("_t", _equals(w))).alias(f"_f{i}") for i, w in enumerate(words)))
    docs = cut(docs)
    stats = docs.agg(F.count("*").alias("_n"), F.avg("_d").alias("_avg"), *(F.count_if(F.col(f"_f{i}") > 0).alias(f"_n{i}") for i in range(len(words))))
    hit = docs.where(reduce(lambda a, b: a & b, [F.col(f"_f{i}") > 0 for i in range(len(words))], F.lit(True))).crossJoin(F.broadcast(stats))  # one row

    def term(i: int) -> Column:
        f, n = F.col(f"_f{i}"), F.col(f"_n{i}")
        idf = F.greatest(F.lit(1e-6), F.log((F.col("_n") - n + 0.5) / (n + 0.5)))
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_d") / F.col("_avg")))

    score = -reduce(lambda a, b: a + b, [term(i) for i in range(len(words))], F.lit(0.0))
    return hit.select(key, F.round(F.when(F.col("_whole"), F.lit(-1e6)).otherwise(score), 6).alias("score"))
