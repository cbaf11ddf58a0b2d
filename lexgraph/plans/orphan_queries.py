"""Queries of problem 2: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import orphans as O
from ..runtime import table


def _found(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "record_tombstone")
    refs = (
        O.references(table(spark, d, "edge"), "edge", "id", "to_node_id", "node")
        .unionByName(O.references(table(spark, d, "graph_edge"), "graph_edge", "edge_id", "evidence_span_id", "source_span"))
        .unionByName(O.references(table(spark, d, "llm_reference_resolution"), "llm_reference_resolution", "id", "target_node_id", "node"))
    )
    known = O.parents(table(spark, d, "node"), "node", "id", gone).unionByName(O.parents(table(spark, d, "source_span"), "source_span", "span_id", gone))
    return O.orphan_references(refs, known)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("ref_table", "ref_id").distinct()


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_counts(_found(spark, d))


_CASES = """
with refs as (
  select 'edge' ref_table, id ref_id, 'node' parent_table, max_by(lower(trim(to_node_id)), loaded_at) k, min(loaded_at) first_at from edge group by id
  union all select 'graph_edge', edge_id, 'source_span', max_by(lower(trim(evidence_span_id)), loaded_at), min(loaded_at) from graph_edge group by edge_id
  union all select 'llm_reference_resolution', id, 'node', max_by(lower(trim(target_node_id)), loaded_at), min(loaded_at) from llm_reference_resolution group by id),
known as (
  select 'node' parent_table, lower(trim(id)) k, min(loaded_at) p_first, max(loaded_at) p_last from node group by 2
  union all select 'source_span', lower(trim(span_id)), min(loaded_at), max(loaded_at) from source_span group by 2),
gone as (select table_name, lower(trim(record_key)) k, max(removed_at) removed_at from record_tombstone group by 1, 2),
cases as (
  select r.ref_table, r.ref_id, r.first_at,
         case when n.k is null then 'missing' when g.removed_at > n.p_last then 'removed' when n.p_first > r.first_at then 'later' end reason
  from refs r left join known n on n.parent_table = r.parent_table and n.k = r.k left join gone g on g.table_name = r.parent_table and g.k = r.k
  where r.k is not null and r.k <> '')
"""

QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts}
ORACLE = {
    "p2_found": _CASES + "select distinct ref_table, ref_id from cases where reason is not null",
    "p2_counts": _CASES + "select ref_table, strftime(first_at, '%Y-%m') period, reason, count(*) n from cases where reason is not null group by 1, 2, 3",
}
