"""Similarity, maps, centrality, communities, parsed pages and a stream over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import semantic as M
from ..operators import store
from ..runtime import scratch, table
from ..sources.html import parse_pages
from ..streaming.events import ingest_once, latest_windows, queue_state, stalls, windowed_counts
from .graph import edges, nodes, twin


def knn_similar_edges(s: SparkSession, d: str) -> DataFrame:
    """The five most similar vectors for every vector whose id is divisible by 100, against all."""
    v = table(s, d, "embeddings")
    near = M.similar(v, v.where("vec_id % 100 = 0"), 5, 0.3)
    return near.select("query", "other", F.format_string("cosine=%.3f", "cosine").alias("evidence"))


def container_vector_mean(s: SparkSession, d: str) -> DataFrame:
    return M.container_means(table(s, d, "embeddings"), "label")


def container_edge_weights(s: SparkSession, d: str) -> DataFrame:
    e = edges(s, d)
    member = e.where("edge_type = 'contains'").groupBy(F.col("to_node_id").alias("id")).agg(F.max("from_node_id").alias("container"))
    return M.container_weights(e, member)


def kmeans_labels(s: SparkSession, d: str) -> DataFrame:
    return M.clusters(table(s, d, "embeddings"))


def pca_projection(s: SparkSession, d: str) -> DataFrame:
    return M.projection(table(s, d, "embeddings"))


def semantic_map(s: SparkSession, d: str) -> DataFrame:
    return M.semantic_map(table(s, d, "embeddings"))


def _analysis(s: SparkSession, d: str) -> DataFrame:
    return edges(s, d).where("edge_type not in ('shares_defined_term', 'has_obligation_pattern') and trim(to_node_id) <> ''")


def betweenness_sampled(s: SparkSession, d: str) -> DataFrame:
    return A.betweenness(_analysis(s, d), 100, 1000)


def communities(s: SparkSession, d: str) -> DataFrame:
    return A.greedy_communities(_analysis(s, d))


def label_communities(s: SparkSession, d: str) -> DataFrame:
    return A.communities(_analysis(s, d))


def communities_modularity(s: SparkSession, d: str) -> DataFrame:
    e = _analysis(s, d)
    c = A.greedy_communities(e)
    return A.modularity(A.induced(e, c), c)


def html_parse_nodes(s: SparkSession, d: str) -> DataFrame:
    return parse_pages(store.latest(table(s, d, "document_source"), "id"))


def simple_graph(s: SparkSession, d: str) -> DataFrame:
    e = edges(s, d)
    return e.select(F.least("from_node_id", "to_node_id").alias("a"), F.greatest("from_node_id", "to_node_id").alias("b")).distinct()


def reference_chains(s: SparkSession, d: str) -> DataFrame:
    """Two-step references: what a node reaches over a node it refers to, counted."""
    e = edges(s, d).where("edge_type in ('references', 'amends')")
    a = e.select(F.col("from_node_id").alias("start"), F.col("to_node_id").alias("mid")).distinct()
    b = e.select(F.col("from_node_id").alias("mid"), F.col("to_node_id").alias("end")).distinct()
    known = nodes(s, d).select(F.col("id").alias("mid"))
    return a.join(b, "mid").join(known, "mid", "left_semi").where("start <> end").groupBy("start").agg(F.countDistinct("end").alias("n"))


def event_windows_stream(s: SparkSession, d: str) -> DataFrame:
    """The hourly counts again, by a stream that reads the table and ends; one file is one batch, so nothing is late."""
    base = scratch(s, "stream")
    windowed_counts(s, f"{d}/events.parquet*", table(s, d, "events").schema, f"{base}/out", f"{base}/state")
    return latest_windows(s, f"{base}/out").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))


def ingest_stream(s: SparkSession, d: str) -> DataFrame:
    """Events delivered as JSON lines in two parts, the second with the first's last days again: each event once."""
    base = scratch(s, "ingest")
    e = table(s, d, "events").select(F.col("event_id").cast("long").alias("event_id"), "event_type", F.col("value").cast("double").alias("value"), F.col("ts").cast("string").alias("ts"))
    half = e.agg(F.expr("timestampadd(SECOND, timestampdiff(SECOND, min(cast(ts as timestamp_ntz)), max(cast(ts as timestamp_ntz))) div 2, min(cast(ts as timestamp_ntz)))").alias("half")).first()["half"]
    at = F.col("ts").cast("timestamp_ntz")
    for part, rows in enumerate((e.where(at <= F.lit(half)), e.where(at > F.lit(half) - F.expr("interval 2 days")))):
        rows.write.json(f"{base}/in/part={part}")
        ingest_once(s, f"{base}/in/part=*", e.schema, "event_id", f"{base}/out", f"{base}/state")
    return s.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_events"))


def queue_states(s: SparkSession, d: str) -> DataFrame:
    """Each user's events as those of a queue item: a click queues it, a view runs it, other events end or fail it."""
    status = F.element_at(F.array(F.lit("pending"), F.lit("running"), F.lit("completed"), F.lit("failed")), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    e = table(s, d, "events").select(F.col("user_id").alias("id"), status.alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return queue_state(e).select("id", "status", F.col("changed_at").cast("string").alias("changed_at"))


def stall_gaps(s: SparkSession, d: str) -> DataFrame:
    g = stalls(table(s, d, "events"), "event_type")
    return g.groupBy("event_type").agg(F.count("*").alias("n"), F.max("seconds").alias("longest"))


QUERIES = {f.__name__: f for f in (knn_similar_edges, container_vector_mean, container_edge_weights, kmeans_labels, pca_projection, semantic_map, betweenness_sampled, communities, label_communities, communities_modularity, html_parse_nodes, simple_graph, reference_chains, event_windows_stream, ingest_stream, queue_states, stall_gaps)}
_W = "{'references': 1.2, 'uses_defined_term': 0.45, 'shares_defined_term': 0.25, 'has_obligation_pattern': 0.35, 'amends': 0.35, 'similar_to': 0.8}"
ORACLE = {
    "knn_similar_edges": "with p as (select q.vec_id as query, x.vec_id as other, round(list_cosine_similarity(q.embedding::double[], x.embedding::double[]), 6) c from embeddings q, embeddings x where q.vec_id % 100 = 0 and q.vec_id <> x.vec_id) select query, other, printf('cosine=%.3f', c) evidence from (select *, row_number() over (partition by query order by c desc, other) k from p where c >= 0.3) where k <= 5",
    "container_vector_mean": "select label, place, round(avg(x), 6) mean from (select label, unnest(range(0, len(embedding)))::int place, unnest(embedding)::double x from embeddings) group by 1, 2",
    "container_edge_weights": twin("""with m as (select to_node_id id, max(from_node_id) container from e where edge_type = 'contains' group by 1),
        p as (select least(a.container, b.container) a, greatest(a.container, b.container) b, edge_type, case when coalesce(confidence, 0) = 0 then 0.5::double else confidence end * (case edge_type when 'references' then 1.2 when 'uses_defined_term' then 0.45 when 'shares_defined_term' then 0.25 when 'has_obligation_pattern' then 0.35 when 'amends' then 0.35 else 0.8 end)::double w from e join m a on a.id = from_node_id join m b on b.id = to_node_id where a.container <> b.container and source_method <> 'site_structure' and edge_type in ('references', 'uses_defined_term', 'shares_defined_term', 'has_obligation_pattern', 'amends', 'similar_to')),
        t as (select a, b, edge_type, count(*) n, sum(w) w from p group by 1, 2, 3), r as (select *, row_number() over (partition by a, b order by n desc, edge_type) k from t),
        x as (select a, b, round(sum(w), 6) weight, max(edge_type) filter (k = 1) dominant, string_agg(edge_type || ': ' || n, ', ' order by k) filter (k <= 4) evidence from r group by 1, 2)
        select a, b, weight, dominant, evidence, round(least(1.0::double, weight / 12), 8) confidence from x order by weight desc, a, b limit 500"""),
    "simple_graph": twin("select distinct least(from_node_id, to_node_id) a, greatest(from_node_id, to_node_id) b from e"),
    "reference_chains": twin("with r as (select distinct from_node_id f, to_node_id t from e where edge_type in ('references', 'amends')) select a.f as start, count(distinct b.t) n from r a join r b on a.t = b.f where a.f <> b.t and a.t in (select id from n) group by 1"),
    "event_windows_stream": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, event_type, count(*) n, round(sum(value), 2) total from events group by 1, 2",
    "ingest_stream": "select event_type, count(*) n, count(distinct event_id) n_events from events group by 1",
    "queue_states": """with recursive s as (select user_id id, ts, ['pending', 'running', 'completed', 'failed'][event_id % 4 + 1] status, row_number() over (partition by user_id order by ts, event_id) k from events),
        f as (select id, 0::bigint k, null::varchar status, null::timestamp changed from (select distinct id from s)
              union all
              select f.id, s.k, case when ok then s.status else f.status end, case when ok then s.ts else f.changed end
              from f join (select *, unnest([null, 'pending', 'running', 'completed', 'failed']) before from s) s on s.id = f.id and s.k = f.k + 1 and s.before is not distinct from f.status,
              lateral (select coalesce((s.before is null and s.status = 'pending') or (s.before in ('pending', 'failed') and s.status = 'running') or (s.before = 'running' and s.status in ('completed', 'failed')), false) ok) o)
        select id, status, rtrim(rtrim(strftime(changed, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') changed_at from (select *, row_number() over (partition by id order by k desc) r from f) where r = 1 and status is not null""",
    "stall_gaps": "select event_type, count(*) n, max(g) longest from (select event_type, date_sub('second', lag(ts) over (partition by event_type order by ts), ts) g from events) where g > 5400 group by 1",
}
