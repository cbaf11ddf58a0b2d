"""Bounded traversal, hierarchies, paths and components as joins over the edge table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import cut
from .quality import explicit
from .store import symmetric


def _whole() -> W:
    """A window over few rows: a frontier is bounded by the limit of the search."""
    return W.partitionBy(F.lit(1))


def neighbourhood(edges: DataFrame, nodes: DataFrame, root: str, depth: int = 1, limit: int = 50, edge_types: tuple[str, ...] = (), only_explicit: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, depth, ord; edges: id) around a root, breadth first.

    Each node that is expanded gives its `limit` best edges in either direction (confidence, then id). Other ends
    join while fewer than `limit` nodes are seen; edges to ends that came too late are kept. Ends that aren't nodes
    are counted but don't come out. Each hop is cut: it reads the edges once and holds at most `limit` nodes.
    """
    if edge_types:
        edges = edges.where(F.col("edge_type").isin(*edge_types))
    if only_explicit:
        edges = edges.where(explicit())
    sym = symmetric(edges, ("id", "confidence"))
    seen = nodes.sparkSession.createDataFrame([(root, 0, 0)], "id string, depth int, ord long")
    frontier, kept = seen, None
    for hop in range(1, depth + 1):
        near = F.broadcast(frontier.select(F.col("id").alias("node"), F.col("ord").alias("f_ord")))  # at most `limit` rows
        inc = cut(sym.join(near, "node").withColumn("r", F.row_number().over(W.partitionBy("node").orderBy(F.col("confidence").desc_nulls_last(), "id"))).where(F.col("r") <= limit))
        fresh = inc.join(F.broadcast(seen.select(F.col("id").alias("other"))), "other", "left_anti").groupBy("other").agg(F.min(F.struct("f_ord", "r")).alias("o"))
        size = seen.count()  # at most `limit`
        ranked = fresh.withColumn("k", F.row_number().over(_whole().orderBy("o.f_ord", "o.r", "other"))).withColumn("size", F.lit(size))
        # A node is expanded only while fewer than `limit` are seen before its turn.
        before = ranked.groupBy(F.col("o.f_ord").alias("f_ord")).agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(_whole().orderBy("f_ord"))).select(F.col("f_ord").alias("g_ord"), "upto")
        turns = frontier.select(F.col("ord").alias("f_ord")).join(before, F.col("g_ord") < F.col("f_ord"), "left").groupBy("f_ord").agg(F.coalesce(F.max("upto"), F.lit(0)).alias("found"))
        turns = turns.where(F.col("found") + size < limit).select("f_ord")
        used = inc.join(F.broadcast(turns), "f_ord", "left_semi").select("id").distinct()
        kept = used if kept is None else kept.unionByName(used)
        fresh = ranked.where(F.col("k") + F.col("size") <= limit).select(F.col("other").alias("id"), F.lit(hop).alias("depth"), (F.col("k") + F.col("size") - 1).alias("ord"))
        frontier = cut(fresh)
        seen = cut(seen.unionByName(frontier))
    return seen.join(nodes.select("id", "node_type", "title"), "id"), kept.distinct()


def descendants(edges: DataFrame, roots: DataFrame, levels: int = 8) -> DataFrame:
    """root, id, depth: what is reached over `contains` within some levels, at its least depth."""
    parts = edges.where("edge_type = 'contains'").select(F.col("from_node_id").alias("id"), F.col("to_node_id").alias("child")).distinct()
    level = roots.select(F.col("id").alias("root"), "id")
    found = None
    for k in range(1, levels + 1):
        level = level.join(parts, "id").select("root", F.col("child").alias("id")).distinct()
        here = level.withColumn("depth", F.lit(k))
        found = here if found is None else found.unionByName(here)
    return found.groupBy("root", "id").agg(F.min("depth").alias("depth"))


def walks(edges: DataFrame, start: str, steps: int = 3) -> DataFrame:
    """id, hops: ends reached by undirected walks that visit no node twice, with their fewest hops."""
    sym = cut(symmetric(edges).distinct())
    seen = edges.sparkSession.createDataFrame([(start, 0)], "id string, hops int")
    front = seen
    for k in range(1, steps + 1):
        front = cut(front.select(F.col("id").alias("node")).join(sym, "node").select(F.col("other").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(k)))
        seen = seen.unionByName(front)
    return seen


def walk_paths(edges: DataFrame, start: str, steps: int = 3, to: str | None = None, most: int | None = None) -> DataFrame:
    """id, hops, path, edge_types: undirected walks from a node that visit no node twice, or those that end in `to`.

    path names the nodes in their order. A walk stops at `to`. With `most`, the first so many by length, then path (a
    report limit). Walks grow with the graph's degree: keep the steps few or the edges to the types wanted.
    """
    sym = cut(symmetric(edges, ("edge_type",)).where("node <> other").distinct())
    front = edges.sparkSession.createDataFrame([(start, 0, [start], [])], "id string, hops int, path array<string>, edge_types array<string>")
    found = None
    for k in range(1, steps + 1):
        go = front if to is None else front.where(F.col("id") != to)
        grown = go.withColumnRenamed("id", "node").join(sym, "node").where(~F.array_contains("path", F.col("other")))
        front = cut(grown.select(F.col("other").alias("id"), F.lit(k).alias("hops"), F.array_append("path", F.col("other")).alias("path"), F.array_append("edge_types", F.col("edge_type")).alias("edge_types")))
        found = front if found is None else found.unionByName(front)
    out = found if to is None else found.where(F.col("id") == to)
    return out if most is None else out.orderBy("hops", F.array_join("path", ">"), F.array_join("edge_types", ">")).limit(most)


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """nth, id, edge_id, edge_type: the nodes of one shortest undirected path, with the edge by which each was reached.

    Of several paths the one that, from the target back, goes by the smallest predecessor and its smallest edge. No
    rows if there is none; one row if both are the same. The search keeps one predecessor of each node it reaches.
    """
    spark = edges.sparkSession
    if source == target:
        return spark.createDataFrame([(0, source, None, None)], "nth int, id string, edge_id string, edge_type string")
    sym = cut(symmetric(edges, ("id", "edge_type")).where("node <> other").select("node", "other", F.col("id").alias("edge_id"), "edge_type"))
    front = spark.createDataFrame([(source,)], "id string")
    seen, levels = front, []
    while not front.isEmpty():
        grown = front.withColumnRenamed("id", "node").join(sym, "node").join(seen.select(F.col("id").alias("other")), "other", "left_anti")
        level = cut(grown.groupBy(F.col("other").alias("id")).agg(F.min(F.struct("node", "edge_id", "edge_type")).alias("by")))
        levels.append(level)
        if not level.where(F.col("id") == target).isEmpty():
            break
        front = level.select("id")
        seen = cut(seen.unionByName(front))
    else:
        return spark.createDataFrame([], "nth int, id string, edge_id string, edge_type string")
    rows, at = [], target
    for nth in range(len(levels), 0, -1):  # as many lookups as the path has edges
        by = levels[nth - 1].where(F.col("id") == at).first()["by"]
        rows.append((nth, at, by["edge_id"], by["edge_type"]))
        at = by["node"]
    return spark.createDataFrame([(0, source, None, None), *reversed(rows)], "nth int, id string, edge_id string, edge_type string")


def shortest_path_lengths(edges: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """source, target, length: fewest undirected hops, null if there is no path (with `most`: none of so many hops).

    The ends of the pairs that are still open grow balls, the smaller frontier first, until these meet or one of them
    has no frontier left. Balls meet first on both frontiers, so only those are held.
    """
    sym = cut(symmetric(edges).distinct().where("node <> other"))
    left = cut(pairs.select("source", "target").distinct())
    ends, found = ("source", "target"), None
    front = {e: cut(left.select(F.col(e).alias("end"), F.col(e).alias("node")).distinct()) for e in ends}
    groups = {e: max(front[e].count(), 1) for e in ends}
    rows, before, hops = dict(groups), {e: front[e].limit(0) for e in ends}, 0
    while True:
        near, far = sorted(ends, key=lambda e: rows[e] / groups[e])
        met = left.join(front[near].withColumnRenamed("end", near), near).join(front[far].withColumnRenamed("end", far), [far, "node"]).select(*ends).distinct()
        met = cut(met.withColumn("length", F.lit(hops)))
        found = met if found is None else found.unionByName(met)
        if hops == most:
            break
        left = left.join(met, list(ends), "left_anti")
        for e in ends:
            left = left.join(front[e].select(F.col("end").alias(e)).distinct(), e, "left_semi")
        left = cut(left)
        if left.isEmpty():
            break
        e = min(ends, key=rows.get)
        grown = front[e].join(left.select(F.col(e).alias("end")).distinct(), "end", "left_semi").join(sym, "node").select("end", F.col("other").alias("node")).distinct()
        # A neighbour of a level lies in that level, the one before or the next.
        grown = cut(grown.join(front[e].unionByName(before[e]), ["end", "node"], "left_anti"))
        before[e], front[e], hops, rows[e] = front[e], grown, hops + 1, grown.count()
    return pairs.join(found, list(ends), "left").select("source", "target", "length")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, component: connected components, named by their smallest id; isolated nodes are their own.

    Large-star and small-star steps, until the links no longer change: O(log n) rounds. A hub's links are combined
    before they are shuffled; what is joined to them is one row a node.
    """
    links = cut(edges.select(F.greatest("from_node_id", "to_node_id").alias("u"), F.least("from_node_id", "to_node_id").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: every node links its smaller neighbours and itself to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        star = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = cut(star)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    every = nodes.select("id").unionByName(edges.select(F.explode(F.array("from_node_id", "to_node_id")).alias("id"))).distinct()
    return every.join(links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def common_neighbours(edges: DataFrame, nodes: DataFrame, a: str, b: str, k: int = 50) -> DataFrame:
    """Neighbours that two nodes share, by their degree in the simple graph."""
    simple = symmetric(edges).where("node <> other").distinct()
    shared = simple.where(F.col("node") == a).select("other").join(simple.where(F.col("node") == b).select("other"), "other").where(~F.col("other").isin(a, b))
    degree = simple.join(shared.select(F.col("other").alias("node")), "node", "left_semi").groupBy(F.col("node").alias("id")).agg(F.count("*").alias("degree"))
    return degree.orderBy(F.desc("degree"), "id").limit(k).join(nodes.select("id", "title"), "id", "left")


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among the members (a column id)."""
    m = members.select("id").distinct()
    return edges.join(m.select(F.col("id").alias("from_node_id")), "from_node_id", "left_semi").join(m.select(F.col("id").alias("to_node_id")), "to_node_id", "left_semi")


def nearest_ancestor(edges: DataFrame, nodes: DataFrame, good: Column, order: Column, levels: int = 8) -> DataFrame:
    """id, ancestor: the nearest node over `contains` parents for which `good` holds, itself included.

    Of several parents the one with the least `order`, then the smallest id, is climbed.
    """
    info = nodes.select("id", good.alias("good"), order.alias("pref"))
    up = edges.where("edge_type = 'contains'").select(F.col("to_node_id").alias("at"), F.col("from_node_id").alias("id")).join(info, "id")
    best = up.groupBy("at").agg(F.min(F.struct("pref", "id", "good")).alias("p")).select("at", F.col("p.id").alias("parent"), F.col("p.good").alias("parent_good"))
    best = cut(best)
    found = info.where("good").select("id", F.col("id").alias("ancestor"))
    # Only what isn't resolved yet climbs on.
    state = info.where("not good or good is null").select("id", F.col("id").alias("at"))
    for _ in range(levels):
        state = cut(state.join(best, "at").select("id", F.col("parent").alias("at"), "parent_good"))
        found = found.unionByName(state.where("parent_good").select("id", F.col("at").alias("ancestor")))
        state = state.where("not parent_good or parent_good is null").select("id", "at")
        if state.isEmpty():
            break
    return found


def roll_up(edges: DataFrame, ancestors: DataFrame, edge_type: str = "references") -> DataFrame:
    """Ends of one edge type replaced by their ancestors; self-edges dropped, equal edges merged.

    from_node_id, to_node_id, edge_type, confidence (the highest), rolled_up_from (the replaced ids in order).
    """
    a = ancestors.where("id <> ancestor")
    refs = edges.where(F.col("edge_type") == edge_type)
    moved = refs.join(a.toDF("from_node_id", "fa"), "from_node_id", "left").join(a.toDF("to_node_id", "ta"), "to_node_id", "left")
    rolled = F.filter(F.array(F.when(F.col("fa").isNotNull(), F.col("from_node_id")), F.when(F.col("ta").isNotNull(), F.col("to_node_id"))), lambda x: x.isNotNull())
    moved = moved.select(F.coalesce("fa", "from_node_id").alias("from_node_id"), F.coalesce("ta", "to_node_id").alias("to_node_id"), "edge_type", "confidence", rolled.alias("r")).where("from_node_id <> to_node_id")
    return moved.groupBy("from_node_id", "to_node_id", "edge_type").agg(F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("r")))), ",").alias("rolled_up_from"))


def natural_key(title: Column, text: Column | None = None) -> list[Column]:
    """Sort columns for legal numbering: structure rank, ordinal, letter suffix, text in lower case."""
    from ..functions.text import roman_to_int

    raw = F.trim(title)
    annex = F.regexp_extract(raw, r"(?i)^annex\s+([IVXLCDM]+)\b", 1)
    article = F.regexp_extract(raw, r"(?i)^art(?:icle|\.)?\s*(\d+)", 1)
    first = F.regexp_extract(raw, r"(\d+)", 1)
    rank = F.when(raw.rlike("(?i)^annex"), 3).when(raw.rlike(r"(?i)^art(icle|\.)?\s*\d"), 2).otherwise(0)
    ordinal = F.when(raw.rlike("(?i)^annex"), F.coalesce(roman_to_int(annex), F.lit(9999))).otherwise(F.coalesce(F.try_to_number(F.nullif(F.when(article != "", article).otherwise(first), F.lit("")), F.lit("999999999")).cast("int"), F.lit(9999)))
    suffix = F.lower(F.regexp_extract(raw, r"\d([A-Za-z])\b", 1))
    return [rank.alias("structure"), ordinal.alias("ordinal"), suffix.alias("suffix"), F.lower(raw).alias("raw")]


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
