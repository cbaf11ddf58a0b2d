"""Tables as versioned stores: latest deliveries, upserts, exact and keyed dedupe, rewiring, placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pick(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given order. Windows over the keys need one shuffle."""
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def latest(df: DataFrame, key: str, at: str = "loaded_at") -> DataFrame:
    """The latest delivery of each record; of several at one time always the same one, by a hash of its columns."""
    return pick(df, [key], [F.col(at).desc_nulls_last(), F.xxhash64(*df.columns)])


def merge(base: DataFrame, delta: DataFrame, key: str, keep_from_base: tuple[str, ...] = ()) -> DataFrame:
    """Upsert by key: rows of delta win, but columns of keep_from_base stay as they were."""
    old, new = base.select("*", F.lit(0).alias("_new")), delta.select(*base.columns, F.lit(1).alias("_new"))
    both = old.unionByName(new)
    first = W.partitionBy(key).orderBy(F.col("_new"))
    for c in keep_from_base:
        both = both.withColumn(c, F.first(c).over(first))
    return pick(both, [key], [F.col("_new").desc()]).drop("_new")


def drop_exact_duplicates(df: DataFrame, key: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Of rows equal in everything but the key (and ignored columns) the smallest key stays."""
    same = [c for c in df.columns if c != key and c not in ignore]
    return pick(df, same, [F.col(key)])


def drop_shadowed(df: DataFrame, shadowed: Column, shadowing: Column, keys: list[Column]) -> DataFrame:
    """Drop rows of one kind for which a row of the other kind has the same (computed) keys."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.withColumns(dict(zip(names, keys)))
    other = keyed.where(shadowing).select(*names).distinct()
    mine = keyed.where(shadowed)
    return keyed.where(~F.coalesce(shadowed, F.lit(False))).unionByName(mine.join(other, names, "left_anti")).drop(*names)


def rewire(edges: DataFrame, mapping: DataFrame, source: str = "from_node_id", target: str = "to_node_id", key: str = "id") -> DataFrame:
    """Replace both ends by mapping(old_id, new_id), drop self-loops that this makes, dedupe (source, target, type)."""
    m = mapping.select("old_id", "new_id")
    a = m.toDF(source, "_f")
    b = m.toDF(target, "_t")
    moved = edges.join(a, source, "left").join(b, target, "left")
    moved = moved.withColumn("_was", F.col(source) == F.col(target)).withColumn(source, F.coalesce("_f", source)).withColumn(target, F.coalesce("_t", target))
    kept = moved.where((F.col(source) != F.col(target)) | F.col("_was")).select(*edges.columns)
    return pick(kept, [source, target, "edge_type"], [F.col(key)])


def placeholders(edges: DataFrame, nodes: DataFrame, target: str = "to_node_id") -> DataFrame:
    """A placeholder node for each edge target that isn't a node: id, node_type, title, n_edges."""
    missing = edges.where(F.trim(target) != "").join(nodes.select(F.col("id").alias(target)), target, "left_anti")
    return missing.groupBy(F.col(target).alias("id")).agg(F.min(F.when(F.trim("evidence_text") != "", F.col("evidence_text"))).alias("_title"), F.count("*").alias("n_edges")).select("id", F.lit("external_reference").alias("node_type"), F.coalesce("_title", "id").alias("title"), "n_edges")


def collapse_parallel(edges: DataFrame, key: str = "id") -> DataFrame:
    """Edges between the same ends with the same type as one: count, highest confidence, first evidence, ids."""
    evidence = F.when(F.trim("evidence_text") != "", F.struct(F.col(key), F.col("evidence_text")))
    return edges.groupBy("from_node_id", "to_node_id", "edge_type").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.min(evidence)["evidence_text"].alias("evidence_text"), F.array_join(F.sort_array(F.collect_list(key)), ",").alias("edge_ids"))


def symmetric(edges: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Both directions of each edge: node, other, and the given columns; a self-loop occurs once."""
    out = edges.select(F.col("from_node_id").alias("node"), F.col("to_node_id").alias("other"), *columns)
    return out.unionByName(edges.where("from_node_id <> to_node_id").select(F.col("to_node_id").alias("node"), F.col("from_node_id").alias("other"), *columns))


def or_join(left: DataFrame, keys: list[Column], right: DataFrame, right_key: str, left_id: str) -> DataFrame:
    """Join on any of several keys as an equi-join: the keys are exploded, matches of one row counted once."""
    exploded = left.withColumn("_k", F.explode(F.array_distinct(F.filter(F.array(*keys), lambda k: k.isNotNull()))))
    return exploded.join(right, exploded["_k"] == right[right_key]).drop("_k").dropDuplicates([left_id, right_key])
