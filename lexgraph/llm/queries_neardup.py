"""Queries of problem 4: near-duplicate rules and guidance paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table
from . import neardup


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, d, "node")).withColumnsRenamed({"id_a": "node_id_a", "id_b": "node_id_b"})


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with its class of equal word sets and its number of links."""
    return neardup.near_duplicate_classes(table(spark, d, "node"))


_PAIRS = r"""
with l as (select id, title, text from node where id is not null qualify row_number() over (partition by id order by loaded_at desc) = 1),
w as (select id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(title, '') || ' ' || text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) w from l
      where text is not null and length(text) <= 1800 and len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) >= 30),
u as (select id, w, len(w) n from w where len(w) > 0),
pr as (select a.id node_id_a, b.id node_id_b from u a join u b on a.id < b.id and 10 * a.n >= 7 * b.n and 10 * b.n >= 7 * a.n
       where 10 * len(list_intersect(a.w, b.w)) >= 7 * (a.n + b.n - len(list_intersect(a.w, b.w))))
"""
QUERIES = {"p4_found": p4_found, "p4_classes": p4_classes}
ORACLE = {
    "p4_found": _PAIRS + "select node_id_a, node_id_b from pr",
    "p4_classes": _PAIRS
    + ", s as (select id, min(id) over (partition by list_sort(w)) class_id, count(*) over (partition by list_sort(w)) n_same from u), k as (select id, count(*) n from (select node_id_a id from pr union all select node_id_b from pr) group by 1) select s.id, class_id, n_same, coalesce(k.n, 0) n_links from s left join k on k.id = s.id",
}
