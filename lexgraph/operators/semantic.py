"""Vectors of nodes: similarity search for a stated query set, means of containers, maps and clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Most bytes of query vectors that are broadcast at once; more queries are joined by blocks.
QUERY_BYTES = 64 << 20
#: Weights of edge types between containers (fixed values).
WEIGHTS = {"references": 1.2, "uses_defined_term": 0.45, "shares_defined_term": 0.25, "has_obligation_pattern": 0.35, "amends": 0.35, "similar_to": 0.8}


def similar(vectors: DataFrame, queries: DataFrame, k: int = 5, least: float = 0.3, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query, other, cosine: the k most similar rows of `vectors` for each row of the stated query set, itself excluded.

    All rows are compared with the queries, block by block; equal cosines (to six places) go to the smaller key. The
    query matrix is broadcast in pieces of a fixed size. Null vectors and those of another length don't take part.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    queries = queries.where(F.col(vec).isNotNull()).select(key, vec)
    size = queries.agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("dim")).first()
    if not size["n"]:
        return spark.createDataFrame([], f"query {kind}, other {kind}, cosine double")
    # The queries come to the driver one piece at a time; a piece is bounded by QUERY_BYTES.
    pieces, dim, parts = -(-size["n"] * size["dim"] * 8 // QUERY_BYTES), size["dim"], []
    for piece in range(pieces):
        got = queries.where(F.pmod(F.xxhash64(key), F.lit(pieces)) == piece).where(F.size(vec) == dim).toArrow()
        if not got.num_rows:
            continue
        ids, q = got.column(key).to_numpy(), np.array(got.column(vec).to_pylist(), dtype=np.float64)
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((ids, q / np.where(norm == 0, 1, norm)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qi, qv = shared.value
            for b in batches:
                rows = [(i, v) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if v is not None and len(v) == dim]
                if not rows:
                    continue
                xi, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
                n = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(n == 0, 1, n)
                for low in range(0, len(qi), 1024):
                    s = np.round(qv[low : low + 1024] @ x.T, 6)
                    s[qi[low : low + 1024, None] == xi[None, :]] = -2
                    m = min(k, s.shape[1])
                    edge = -np.partition(-s, m - 1, axis=1)[:, m - 1]
                    a, c = np.nonzero((s >= edge[:, None]) & (s >= least))
                    yield pa.RecordBatch.from_arrays([pa.array(qi[low + a], b.schema.field(0).type), pa.array(xi[c], b.schema.field(0).type), pa.array(s[a, c])], ["query", "other", "cosine"])

        parts.append(vectors.select(key, vec).mapInArrow(run, f"query {kind}, other {kind}, cosine double"))
    near = parts[0]
    for p in parts[1:]:
        near = near.unionByName(p)
    w = W.partitionBy("query").orderBy(F.desc("cosine"), "other")
    return near.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).drop("nth")


def container_means(vectors: DataFrame, container: str, vec: str = "embedding") -> DataFrame:
    """container, place, mean: the mean vector of each container, one row per component."""
    each = vectors.where(F.col(vec).isNotNull()).select(container, F.posexplode(vec).alias("place", "x"))
    return each.groupBy(container, "place").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def container_weights(edges: DataFrame, member: DataFrame, most: int = 500) -> DataFrame:
    """a < b, weight, dominant, evidence, confidence for the `most` heaviest pairs of containers (a report limit).

    member(id, container). An edge weighs its confidence (0.5 if null or zero) times its type's weight; structural
    edges and those inside one container don't count.
    """
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    own = edges.where(F.col("edge_type").isin(*WEIGHTS) & (F.col("source_method") != "site_structure"))
    m = member.select("id", "container")
    j = own.join(m.toDF("from_node_id", "ca"), "from_node_id").join(m.toDF("to_node_id", "cb"), "to_node_id").where("ca <> cb")
    conf = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 0.5).otherwise(F.col("confidence"))
    pair = j.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "edge_type", (conf * weight[F.col("edge_type")]).alias("w"))
    by_type = pair.groupBy("a", "b", "edge_type").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "edge_type")))
    total = by_type.groupBy("a", "b").agg(F.round(F.sum("w"), 6).alias("weight"), order.alias("t"))
    text = F.array_join(F.transform(F.slice("t", 1, 4), lambda x: F.concat(x["edge_type"], F.lit(": "), (-x["k"]).cast("string"))), ", ")
    top = total.orderBy(F.desc("weight"), "a", "b").limit(most)
    return top.select("a", "b", "weight", F.col("t")[0]["edge_type"].alias("dominant"), text.alias("evidence"), F.round(F.least(F.lit(1.0), F.col("weight") / 12), 8).alias("confidence"))


def clusters(vectors: DataFrame, k: int = 12, key: str = "vec_id", vec: str = "embedding", seed: int = 42) -> DataFrame:
    """key, cluster by distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = vectors.where(F.col(vec).isNotNull()).select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed).fit(x).transform(x).select(key, F.col("prediction").alias("cluster"))


def projection(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", width: tuple[float, float] = (120.0, 1080.0), height: tuple[float, float] = (100.0, 720.0)) -> DataFrame:
    """key, x, y: the first two principal components scaled to a canvas; a span of zero maps to its start."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = vectors.where(F.col(vec).isNotNull()).select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    p = PCA(k=2, inputCol="features", outputCol="pc").fit(x).transform(x).select(key, vector_to_array("pc").alias("pc"))
    span = p.agg(*(f(F.col("pc")[i]).alias(f"{n}{i}") for i in (0, 1) for n, f in (("lo", F.min), ("hi", F.max))))

    def scale(i: int, low: float, high: float):
        d = F.col(f"hi{i}") - F.col(f"lo{i}")
        return F.round(low + (F.col("pc")[i] - F.col(f"lo{i}")) / F.when(d == 0, 1).otherwise(d) * (high - low), 3)

    return p.crossJoin(F.broadcast(span)).select(key, scale(0, *width).alias("x"), scale(1, *height).alias("y"))  # one row


def semantic_map(vectors: DataFrame, k: int = 12, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """key, x, y, cluster."""
    return projection(vectors, key, vec).join(clusters(vectors, k, key, vec), key)
