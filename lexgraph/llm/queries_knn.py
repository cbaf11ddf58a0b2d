"""Queries of problem 3: most similar vectors of every node."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, table
from . import knn


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nodes of the same model with the highest cosine, for each node with a usable vector."""
    return knn.nearest(knn.usable_vectors(table(spark, d, "embedding")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = knn.nearest(knn.usable_vectors(table(spark, d, "embedding")), least=0.9)
    return knn.similar_pairs(found, 0.9).withColumnsRenamed({"id_a": "node_id_a", "id_b": "node_id_b"})


def p3_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the five nearest for the nodes whose id (a number in base 16) is divisible by 100, against all."""
    vectors = cut(knn.usable_vectors(table(spark, d, "embedding")))
    stated = F.conv("id", 16, 10).cast("decimal(20,0)") % 100 == 0
    return knn.recall(vectors, knn.nearest(vectors), stated)


_NEAR = """
with v as (select node_id, model_name, created_at, vector_json, try_cast(try_cast(vector_json as json) as double[]) v from embedding where node_id is not null and model_name is not null),
f as (select * from v where len(v) > 0 and json_type(vector_json::json) = 'ARRAY' and len(list_filter(json_extract(vector_json::json, '$[*]'), lambda x: json_type(x) in ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT'))) = len(v) and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
dm as (select model_name, arg_max(n, {'c': c, 'n': n}) dim from (select model_name, len(v) n, count(*) c from f group by all) group by 1),
l as (select f.* from f join dm on dm.model_name = f.model_name and len(f.v) = dm.dim qualify row_number() over (partition by node_id, f.model_name order by coalesce(created_at, '') desc, vector_json desc) = 1),
pr as (select a.node_id a, b.node_id b, a.model_name, round(list_cosine_similarity(a.v, b.v), 9) c from l a join l b on a.model_name = b.model_name and a.node_id <> b.node_id),
tp as (select * from pr qualify row_number() over (partition by model_name, a order by c desc, b) <= 5)
"""
QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours, "p3_recall": p3_recall}
ORACLE = {"p3_found": _NEAR + "select distinct least(a, b) node_id_a, greatest(a, b) node_id_b from tp where c >= 0.9"}
