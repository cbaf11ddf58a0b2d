"""References to records that do not exist.

Distinct non-null keys of every referring table are anti-joined against the parent's keys (with the parent's
life span: first load, last load, removal) and the few keys that fail are joined back to the references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: How many salted copies of each failing key the join back makes, so that one key that holds a third of all
#: references is spread over as many tasks.
SALTS = 16


def clean_key(c: Column) -> Column:
    """Keys are compared without surrounding white space and case; a blank key is null."""
    k = F.lower(F.regexp_replace(c, r"(?U)^[\s\p{Z}\p{Cc}\p{Cf}]+|[\s\p{Z}\p{Cc}\p{Cf}]+$", ""))
    return F.when(F.length(k) > 0, k)


def references(df: DataFrame, ref_table: str, id_col: str, key_col: str, parent_table: str, loaded_col: str = "loaded_at") -> DataFrame:
    """One row per referring record: ref_table, ref_id, parent_table, key, first_at (its first load).

    Deliveries of one id are one record; its key is that of the latest delivery, its time that of the first.
    Records with a null id are kept as one record per key. Null and blank keys yield no row.
    """
    rows = df.select(F.col(id_col).cast("string").alias("ref_id"), clean_key(F.col(key_col)).alias("key"), F.col(loaded_col).cast("timestamp_ntz").alias("at"))
    # Records without an id are told apart by their key: one aggregate serves both.
    own = rows.withColumn("own", F.when(F.col("ref_id").isNull(), F.col("key")))
    one = own.groupBy("ref_id", "own").agg(F.max_by(F.struct("key"), F.struct("at", "key"))["key"].alias("key"), F.min("at").alias("first_at"))
    return one.where("key is not null").select(F.lit(ref_table).alias("ref_table"), "ref_id", F.lit(parent_table).alias("parent_table"), "key", "first_at")


def parents(df: DataFrame, parent_table: str, key_col: str, tombstones: DataFrame | None = None, loaded_col: str = "loaded_at") -> DataFrame:
    """One row per parent key: first and last load, and whether it was removed after the last load."""
    rows = df.select(clean_key(F.col(key_col)).alias("key"), F.col(loaded_col).cast("timestamp_ntz").alias("at")).where("key is not null")
    life = rows.select("key", "at", F.lit(None).cast("timestamp_ntz").alias("gone"))
    if tombstones is not None:
        gone = tombstones.where(F.col("table_name") == parent_table).select(clean_key(F.col("record_key")).alias("key"), F.col("removed_at").cast("timestamp_ntz").alias("gone"))
        life = life.unionByName(gone.where("key is not null").select("key", F.lit(None).cast("timestamp_ntz").alias("at"), "gone"))
        present = F.max(F.when(F.col("gone").isNull(), 1))
    else:
        present = F.lit(1)
    out = life.groupBy("key").agg(F.min("at").alias("p_first"), F.max("at").alias("p_last"), F.max("gone").alias("p_gone"), present.alias("present"))
    return out.where("present = 1").select(F.lit(parent_table).alias("parent_table"), "key", "p_first", F.coalesce(F.col("p_gone") > F.col("p_last"), F.lit(False)).alias("removed"))


def orphan_references(refs: DataFrame, known: DataFrame) -> DataFrame:
    """References whose key is missing, was removed, or was first loaded after the reference.

    refs as of references(), known as of parents(), either over several tables at once.
    Returns ref_table, ref_id, key, first_at, reason (missing, removed, later). Empty inputs give an empty result;
    a reference or parent without a load time is never `later`. Both inputs are read once.
    """
    refs, known = cut(refs), cut(known)
    keys = cut(refs.groupBy("parent_table", "key").agg(F.min("first_at").alias("earliest")))
    missing = keys.join(known, ["parent_table", "key"], "left_anti").select("parent_table", "key", F.lit("missing").alias("why"), F.lit(None).cast("timestamp_ntz").alias("p_first"))
    doubtful = keys.join(known, ["parent_table", "key"]).where(F.col("removed") | (F.col("p_first") > F.col("earliest")))
    failing = missing.unionByName(doubtful.select("parent_table", "key", F.when(F.col("removed"), "removed").otherwise("later").alias("why"), "p_first"))
    salted = failing.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    back = refs.withColumn("salt", F.pmod(F.xxhash64("ref_table", "ref_id", "first_at"), F.lit(SALTS)).cast("int")).join(salted, ["parent_table", "key", "salt"])
    return back.where((F.col("why") != "later") | (F.col("p_first") > F.col("first_at"))).select("ref_table", "ref_id", "key", "first_at", F.col("why").alias("reason"))


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per referring table, calendar month of the reference's load and reason."""
    return orphans.groupBy("ref_table", F.date_format("first_at", "yyyy-MM").alias("period"), "reason").agg(F.count("*").alias("n"))
