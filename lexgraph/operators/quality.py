"""Counts, degrees and data-quality checks over a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_blank, json_true, ladder

#: Methods whose edges are stated in a source rather than derived (fixed values).
EXPLICIT = ("site_structure", "html_glossary_link", "html_link", "html_anchor", "regex_rule_reference", "instrument_listing", "llm_reference")
#: Node types that stand for something referred to but not held.
PLACEHOLDERS = ("rule_reference", "external_reference")


def explicit(method: Column = None) -> Column:  # noqa: RUF013
    return (F.col("source_method") if method is None else method).isin(*EXPLICIT)


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def edge_matrix(edges: DataFrame) -> DataFrame:
    """Count and confidence range of each edge type and method."""
    return edges.groupBy("edge_type", "source_method").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 3).alias("avg_confidence"), F.round(F.min("confidence"), 3).alias("min_confidence"), F.round(F.max("confidence"), 3).alias("max_confidence"))


def degrees(edges: DataFrame) -> DataFrame:
    """in_degree, out_degree and degree of each end; a self-loop counts in both directions."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("from_node_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_node_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy(F.col("x.id").alias("id")).agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"), F.count("*").alias("degree"))


def top_degree(edges: DataFrame, nodes: DataFrame, k: int = 40) -> DataFrame:
    """The k most connected ends with their node's type and title (null for ends that are no node)."""
    top = degrees(edges).orderBy(F.desc("degree"), "id").limit(k)
    return top.join(nodes.select("id", "node_type", "title"), "id", "left")


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    n = F.count("*")
    return df.groupBy(key).agg(n.alias("n")).withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(W.partitionBy()), 2))


def hard_soft(edges: DataFrame) -> DataFrame:
    """Explicit and derived edges; edges without a method are in neither."""
    return edges.agg(F.count_if(explicit()).alias("hard"), F.count_if(~explicit()).alias("soft"), F.count("*").alias("total"))


def missing_evidence(edges: DataFrame) -> DataFrame:
    """Metrics of what edges lack, in one pass."""
    text, url, conf = is_blank(F.col("evidence_text")), is_blank(F.col("source_url")), F.col("confidence").isNull()
    row = edges.agg(F.count("*").alias("edges"), F.count_if(text).alias("no_text"), F.count_if(url).alias("no_url"), F.count_if(text & url).alias("no_text_and_url"), F.count_if(conf).alias("no_confidence"), F.count_if(explicit() & text & url).alias("hard_without_any"), F.count_if(F.col("source_method").isNull()).alias("no_method"))
    return row.unpivot([], row.columns, "metric", "n")


def duplicate_groups(df: DataFrame, *keys: Column) -> DataFrame:
    """Groups of rows equal in the keys: how many groups and how many rows too many."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("excess"))


def near_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between different nodes of the same type, title and non-blank text."""
    n = nodes.where(~is_blank(F.col("text"))).select("id", "node_type", "title", "text")
    a = n.toDF("from_node_id", "a_type", "a_title", "a_text")
    b = n.toDF("to_node_id", "b_type", "b_title", "b_text")
    hit = edges.where("from_node_id <> to_node_id").join(a, "from_node_id").join(b, "to_node_id")
    return hit.where((F.col("a_type") == F.col("b_type")) & (F.col("a_title") == F.col("b_title")) & (F.col("a_text") == F.col("b_text"))).select("id", "from_node_id", "to_node_id", "edge_type")


def placeholder_status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Placeholder nodes: live (a references edge ends there), other (only other edges), orphan (no edge)."""
    holders = nodes.where(F.col("node_type").isin(*PLACEHOLDERS) | json_true(F.col("metadata_json"), "$.placeholder")).select("id")
    into = edges.groupBy(F.col("to_node_id").alias("id")).agg(F.max((F.col("edge_type") == "references").cast("int")).alias("ref"))
    out = edges.select(F.col("from_node_id").alias("id")).distinct().withColumn("out", F.lit(1))
    status = F.when(F.col("ref") == 1, "live").when(F.col("ref").isNotNull() | F.col("out").isNotNull(), "other").otherwise("orphan")
    return holders.join(into, "id", "left").join(out, "id", "left").select("id", status.alias("status"))


def reference_pattern(node_type: Column, title: Column, url: Column, stable_key: Column) -> Column:
    """Which kind of reference an unresolved placeholder is, by a ladder over its title, URL and key."""
    text = F.trim(F.coalesce(title, F.lit("")))
    low = F.lower(text)
    hay = F.lower(F.concat_ws(" ", text, F.coalesce(url, F.lit("")), F.coalesce(stable_key, F.lit(""))))
    host = F.lower(F.regexp_extract(F.regexp_replace(F.coalesce(url, F.lit("")), "external:|url:", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    steps = [
        ((node_type == "rule_reference") & F.contains(hay, F.lit("pra-rules/")), "Internal rule URL needing resolver context"),
        (F.contains(hay, F.lit("guidance/supervisory-statements")) | hay.rlike(r"\bss\d+[-/]\d+\b"), "Supervisory statement reference"),
        (F.contains(hay, F.lit("guidance/statements-of-policy")) | hay.rlike(r"\bsop\d*[-/]?\d*\b"), "Statement of policy reference"),
        (low.isin("here", "click here"), "Generic link text"),
        (low.rlike(r"^(https?://|www\.)"), "Raw URL title"),
        (text.rlike(r"^(?i:\d+(\.\d+)*[a-z]?([()\w–-]+)?)$"), "Bare paragraph/rule number"),
        (text.rlike(r"^(?i:chapter|article|section|annex|appendix|part)\b"), "Generic structural label"),
    ]
    return F.coalesce(ladder(steps), F.when(host != "", F.concat(F.lit("External site: "), host)), F.lit("Other unresolved pattern"))
