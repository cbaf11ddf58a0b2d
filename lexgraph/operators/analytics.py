"""Centrality and communities. Exact algorithms run on an induced subgraph of stated size, spread over sources."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .quality import degrees
from .store import symmetric
from .traverse import induced


def top_subgraph(edges: DataFrame, most: int) -> DataFrame:
    """Edges among the `most` best connected ends: the feature's stated size."""
    top = degrees(edges).orderBy(F.desc("degree"), "id").limit(most).select("id")
    return induced(edges, top)


def betweenness(edges: DataFrame, k: int = 100, most: int = 1000, seed: int = 42) -> DataFrame:
    """id, score: betweenness from k sampled sources (all, if k is large enough), normalised, on the top subgraph.

    One breadth-first accumulation per source; sources are spread over tasks, the adjacency (at most `most` nodes) is
    broadcast.
    """
    spark = edges.sparkSession
    sub = symmetric(top_subgraph(edges, most)).where("node <> other").distinct()
    links = sub.toArrow()  # at most `most` squared, the stated size
    names = sorted(set(links.column("node").to_pylist()))
    if not names:
        return spark.createDataFrame([], "id string, score double")
    at = {x: i for i, x in enumerate(names)}
    adj: list[list[int]] = [[] for _ in names]
    for a, b in zip(links.column("node").to_pylist(), links.column("other").to_pylist()):
        adj[at[a]].append(at[b])
    adj = [sorted(x) for x in adj]
    n, shared = len(names), spark.sparkContext.broadcast((names, adj))
    picks = list(range(n)) if k >= n else sorted(np.random.default_rng(seed).choice(n, k, replace=False).tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, adj = shared.value
        total = np.zeros(len(names))
        for b in batches:
            for s in b.column(0).to_pylist():
                dist, sigma, order, pred = {s: 0}, {s: 1.0}, [], {s: []}
                queue = deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for w in adj[v]:
                        if w not in dist:
                            dist[w], sigma[w], pred[w] = dist[v] + 1, 0.0, []
                            queue.append(w)
                        if dist[w] == dist[v] + 1:
                            sigma[w] += sigma[v]
                            pred[w].append(v)
                delta = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in pred[w]:
                        delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
                    if w != s:
                        total[w] += delta[w]
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in hit], pa.string()), pa.array(total[hit])], ["id", "part"])

    sources = spark.createDataFrame([(i,) for i in picks], "s int").repartition(max(1, min(len(picks), spark.sparkContext.defaultParallelism)))
    scale = 1.0 / max(1, (n - 1) * (n - 2)) * (n / len(picks))
    return sources.mapInArrow(run, "id string, part double").groupBy("id").agg(F.round(F.sum("part") * scale, 9).alias("score"))


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """id, community by label propagation over the whole simple graph: every node takes its neighbours' most frequent
    label (ties: the smallest). Two shuffles a round; ends when no label changes.

    The synchronous form may swing between two states, so a node changes only to a smaller label in even rounds, and
    from round `rounds` on in every round; as labels can't sink for ever, it converges.
    """
    sym = cut(symmetric(edges).where("node <> other").distinct())
    labels = cut(sym.select(F.col("node").alias("id")).distinct().withColumn("label", F.col("id")))
    r = 0
    while True:
        both = r % 2 == 1 and r < rounds
        votes = sym.join(labels.toDF("other", "vote"), "other").groupBy("node", "vote").agg(F.count("*").alias("n"))
        best = votes.groupBy(F.col("node").alias("id")).agg(F.min(F.struct((-F.col("n")).alias("n"), "vote"))["vote"].alias("best"))
        change = F.lit(both) | (F.col("best") < F.col("label"))
        nxt = cut(labels.join(best, "id").select("id", F.when(change, F.col("best")).otherwise(F.col("label")).alias("label"), (change & (F.col("best") != F.col("label"))).alias("moved")))
        if nxt.where("moved").isEmpty() and (both or r >= rounds):
            break
        labels, r = nxt.drop("moved"), r + 1
    return labels.select("id", F.col("label").alias("community"))


def _merge_greedily(n: int, links: list[tuple[int, int]]) -> list[int]:
    """Greedy modularity: join the pair of communities with the greatest gain until none gains; the label of each node."""
    import heapq

    m = len(links)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b in links:
        near[a][b] = near[b][a] = near[a].get(b, 0.0) + 1.0
    deg = [sum(x.values()) for x in near]
    gain = [{j: 2 * (w / (2 * m) - deg[i] * deg[j] / (2 * m) ** 2) for j, w in near[i].items()} for i in range(n)]
    share = [d / (2 * m) for d in deg]
    heap = [(-q, i, j) for i in range(n) for j, q in gain[i].items() if i < j]
    heapq.heapify(heap)
    label, alive = list(range(n)), [True] * n
    members = [[i] for i in range(n)]
    while heap:
        q, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or abs(gain[i].get(j, 1e9) + q) > 1e-15:
            continue
        if -q <= 0:
            break
        # i takes j in; gains to common and single neighbours follow from both.
        if len(gain[i]) < len(gain[j]):
            i, j = j, i
        alive[j] = False
        members[i] += members[j]
        for k in set(gain[i]) | set(gain[j]):
            if k in (i, j):
                continue
            a, b = gain[i].get(k), gain[j].get(k)
            v = a + b if a is not None and b is not None else a - 2 * share[j] * share[k] if a is not None else b - 2 * share[i] * share[k]
            gain[i][k] = gain[k][i] = v
            gain[k].pop(j, None)
            heapq.heappush(heap, (-v, *sorted((i, k))))
        gain[i].pop(j, None)
        gain[j] = {}
        share[i] += share[j]
    for i in range(n):
        if alive[i]:
            low = min(members[i])
            for x in members[i]:
                label[x] = low
    return label


def greedy_communities(edges: DataFrame, most: int = 2500) -> DataFrame:
    """id, community by greedy modularity on the subgraph of the `most` best connected ends, the feature's stated size.

    The subgraph is brought to the driver, which holds at most `most` nodes and their links among each other.
    """
    spark = edges.sparkSession
    links = symmetric(top_subgraph(edges, most)).where("node < other").distinct().toArrow()
    pairs = list(zip(links.column("node").to_pylist(), links.column("other").to_pylist()))
    names = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(names)}
    label = _merge_greedily(len(names), sorted((at[a], at[b]) for a, b in pairs)) if pairs else []
    return spark.createDataFrame([(x, names[c]) for x, c in zip(names, label)], "id string, community string")


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row: modularity of a partition (id, community) of the simple graph."""
    simple = edges.select(F.least("from_node_id", "to_node_id").alias("a"), F.greatest("from_node_id", "to_node_id").alias("b")).where("a <> b").distinct()
    m = members.select("id", "community")
    j = simple.join(m.toDF("a", "ca"), "a").join(m.toDF("b", "cb"), "b")
    ends = j.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count("*").alias("k"))
    inside = j.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.count("*").alias("i"))
    total = simple.agg(F.count("*").cast("double").alias("m"))
    each = ends.join(inside, "c", "left").crossJoin(F.broadcast(total))  # one row
    return each.agg(F.round(F.sum(F.coalesce("i", F.lit(0)) / F.col("m") - F.pow(F.col("k") / (2 * F.col("m")), 2)), 6).alias("modularity"))
