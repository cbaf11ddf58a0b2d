"""Reporting lineage: data items, templates, datapoints and source documents as a star of narrow edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def typed_counts(items: DataFrame, edges: DataFrame, types: dict[str, str]) -> DataFrame:
    """For each item the number of different targets by edge type; 0 where it has none. One aggregate over edges."""
    counts = edges.groupBy("source").agg(*(F.countDistinct(F.when(F.col("edge_type") == t, F.col("target"))).alias(name) for name, t in types.items()))
    return items.join(counts.withColumnRenamed("source", "id"), "id", "left").na.fill(0, list(types))


def branch_counts(items: DataFrame, branches: dict[str, DataFrame]) -> DataFrame:
    """Counts over several one-to-many branches: each is aggregated before the join, so that none multiplies another."""
    for name, b in branches.items():
        items = items.join(b.groupBy("id").agg(F.countDistinct("other").alias(name)), "id", "left").na.fill(0, [name])
    return items


def relying_on(edges: DataFrame, evidence: str, reference: str) -> DataFrame:
    """target, source, via: items whose evidence documents refer to a target, with the documents in order."""
    docs = edges.where(F.col("edge_type") == evidence).select(F.col("source").alias("item"), F.col("target").alias("doc"))
    refs = edges.where(F.col("edge_type") == reference).select(F.col("source").alias("doc"), "target")
    return docs.join(refs, "doc").groupBy("target", F.col("item").alias("source")).agg(F.array_join(F.sort_array(F.collect_set("doc")), ",").alias("via"))


def grouped_samples(rows: DataFrame, group: str, label: str, most: int = 8) -> DataFrame:
    """group, n, samples: how many rows and the first few different labels in order."""
    distinct = rows.select(group, label).distinct().withColumn("k", F.row_number().over(W.partitionBy(group).orderBy(label))).where(F.col("k") <= most)
    some = distinct.groupBy(group).agg(F.array_join(F.sort_array(F.collect_list(label)), "|").alias("samples"))
    return rows.groupBy(group).agg(F.count("*").alias("n")).join(some, group)


def newest_of_family(df: DataFrame, family: str, version: str) -> DataFrame:
    """Rows of the newest version of each family; ties stay. Families are reduced to one row before they are joined."""
    newest = df.groupBy(F.col(family).alias("_family")).agg(F.max(version).alias("_newest"))
    return df.join(newest, F.col(family).eqNullSafe(F.col("_family"))).where(F.col(version) == F.col("_newest")).select(*df.columns)


def without_edge(items: DataFrame, edges: DataFrame, edge_type: str) -> DataFrame:
    return items.join(edges.where(F.col("edge_type") == edge_type).select(F.col("source").alias("id")), "id", "left_anti")
