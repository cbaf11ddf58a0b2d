"""Statistics and data-quality queries over the rulebook graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import json_true, norm_words
from ..operators import quality as Q
from ..operators import store
from .graph import edges, gedges, nodes, seeded, seeded_edges, seeded_nodes, twin


def stats_nodes_by_type(s: SparkSession, d: str) -> DataFrame:
    return Q.counts_by(nodes(s, d), "node_type")


def stats_edges_by_type(s: SparkSession, d: str) -> DataFrame:
    return Q.counts_by(edges(s, d), "edge_type")


def missing_edge_targets(s: SparkSession, d: str) -> DataFrame:
    gone = edges(s, d).select(F.col("to_node_id").alias("id"), "edge_type").join(nodes(s, d).select("id"), "id", "left_anti")
    return gone.groupBy("edge_type").agg(F.count("*").alias("n"), F.countDistinct("id").alias("targets"))


def edges_by_type_method(s: SparkSession, d: str) -> DataFrame:
    return Q.edge_matrix(edges(s, d))


def reporting_edges_by_type_method(s: SparkSession, d: str) -> DataFrame:
    return Q.edge_matrix(gedges(s, d).withColumnRenamed("extraction_method", "source_method"))


def high_degree_nodes(s: SparkSession, d: str) -> DataFrame:
    return Q.top_degree(edges(s, d), nodes(s, d), 40)


def degree_centrality(s: SparkSession, d: str) -> DataFrame:
    return Q.degrees(edges(s, d)).select("id", "degree")


def edge_type_share(s: SparkSession, d: str) -> DataFrame:
    return Q.share_of_total(edges(s, d), "edge_type")


def hard_soft_split(s: SparkSession, d: str) -> DataFrame:
    return Q.hard_soft(edges(s, d))


def missing_evidence_metrics(s: SparkSession, d: str) -> DataFrame:
    return Q.missing_evidence(edges(s, d))


def duplicate_logical_groups(s: SparkSession, d: str) -> DataFrame:
    n, e = nodes(s, d), edges(s, d)
    parts = [("nodes_title_text", Q.duplicate_groups(n.where("trim(coalesce(text, '')) <> ''"), F.col("node_type"), F.col("title"), F.col("text"))), ("nodes_norm_title", Q.duplicate_groups(n, F.col("node_type"), norm_words(F.col("title")))), ("edges_exact", Q.duplicate_groups(e, F.col("from_node_id"), F.col("to_node_id"), F.col("edge_type"), F.col("source_method"), F.col("evidence_text")))]
    out = None
    for name, g in parts:
        g = g.select(F.lit(name).alias("metric"), "groups", "excess")
        out = g if out is None else out.unionByName(g)
    return out


def self_loops(s: SparkSession, d: str) -> DataFrame:
    return edges(s, d).where("from_node_id = to_node_id").select("id", "from_node_id", "edge_type")


def near_self_loops(s: SparkSession, d: str) -> DataFrame:
    return Q.near_self_loops(seeded_edges(s, d), seeded_nodes(s, d))


def unresolved_reference_summary(s: SparkSession, d: str) -> DataFrame:
    return Q.counts_by(Q.placeholder_status(nodes(s, d), edges(s, d)), "status")


def unresolved_pattern_buckets(s: SparkSession, d: str) -> DataFrame:
    """Placeholders that are referred to, by the pattern of their titles and URLs, with up to twelve examples."""
    n = nodes(s, d).where("node_type in ('external_reference', 'rule_reference')").where(json_true(F.col("metadata_json"), "$.placeholder"))
    into = edges(s, d).where("edge_type = 'references'").groupBy(F.col("to_node_id").alias("id")).agg(F.count("*").alias("live"))
    held = n.join(into, "id").select("id", "title", "live", Q.reference_pattern(F.col("node_type"), F.col("title"), F.col("url"), F.col("stable_key")).alias("pattern"))
    top = held.withColumn("k", F.row_number().over(W.partitionBy("pattern").orderBy("title", "id"))).where("k <= 12").groupBy("pattern").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "title"))), lambda x: x["title"]), "|").alias("examples"))
    return held.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("live").alias("live_edges")).join(top, "pattern")


def unresolved_samples_ids(s: SparkSession, d: str) -> DataFrame:
    """The first 40 unresolved references with display ids: a report of fixed length."""
    live = Q.placeholder_status(nodes(s, d), edges(s, d)).where("status = 'live'").join(nodes(s, d).select("id", "title"), "id").orderBy("title", "id").limit(40)
    return live.select("id", "title", F.format_string("UR-%04d", F.row_number().over(W.orderBy("title", "id"))).alias("display_id"))


def exact_edge_dedupe(s: SparkSession, d: str) -> DataFrame:
    return Q.counts_by(store.drop_exact_duplicates(edges(s, d), "id", ("loaded_at", "metadata_json", "confidence", "source_url")), "edge_type")


def semi_key_dedupe(s: SparkSession, d: str) -> DataFrame:
    e = edges(s, d)
    keys = [F.col("from_node_id"), F.col("to_node_id"), F.col("edge_type"), F.coalesce(F.get_json_object("metadata_json", "$.reference"), F.col("evidence_text"))]
    left = store.drop_shadowed(e, F.col("source_method").startswith("regex"), F.col("source_method").isin("html_anchor", "llm_reference"), keys)
    return Q.counts_by(left, "source_method")


def parallel_edge_collapse(s: SparkSession, d: str) -> DataFrame:
    return store.collapse_parallel(edges(s, d))


def placeholder_backfill(s: SparkSession, d: str) -> DataFrame:
    return store.placeholders(edges(s, d), nodes(s, d))


def edge_upsert_latest(s: SparkSession, d: str) -> DataFrame:
    """The deliveries of the last month merged into those before."""
    from ..runtime import table

    t = table(s, d, "edge")
    cut = F.expr("timestamp_ntz '2025-06-01 00:00:00'")
    merged = store.merge(store.latest(t.where(F.col("loaded_at") < cut), "id"), store.latest(t.where(F.col("loaded_at") >= cut), "id"), "id", ("source_url",))
    return merged.select("id", "edge_type", "source_url", F.round("confidence", 3).alias("confidence"), F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss").alias("loaded"))


def orphan_prune(s: SparkSession, d: str) -> DataFrame:
    orphans = Q.placeholder_status(nodes(s, d), edges(s, d)).where("status = 'orphan'")
    return Q.counts_by(nodes(s, d).join(orphans, "id", "left_anti"), "node_type")


def identity_buckets(s: SparkSession, d: str) -> DataFrame:
    return nodes(s, d).groupBy("node_type", norm_words(F.col("title")).alias("norm_title")).agg(F.count("*").alias("n")).where("n > 1")


def orphan_nodes(s: SparkSession, d: str) -> DataFrame:
    e = edges(s, d)
    used = e.select(F.col("from_node_id").alias("id")).unionByName(e.select(F.col("to_node_id").alias("id"))).distinct()
    return Q.counts_by(nodes(s, d).join(used, "id", "left_anti"), "node_type")


def low_confidence_edges(s: SparkSession, d: str) -> DataFrame:
    return gedges(s, d).where("confidence < 0.75").groupBy("edge_type", "review_status").agg(F.count("*").alias("n"), F.round(F.min("confidence"), 3).alias("least"))


_HARD = "('site_structure', 'html_glossary_link', 'html_link', 'html_anchor', 'regex_rule_reference', 'instrument_listing', 'llm_reference')"
_PH = """ph as (select id, title from n where node_type in ('rule_reference', 'external_reference') or coalesce(lower(case when json_valid(metadata_json) then metadata_json->>'$.placeholder' end) in ('true', '1'), false)),
st as (select p.id, p.title, case when exists (select 1 from e where to_node_id = p.id and edge_type = 'references') then 'live' when exists (select 1 from e where to_node_id = p.id or from_node_id = p.id) then 'other' else 'orphan' end status from ph p)"""
_DEG = "dg as (select id, sum(i) in_degree, sum(o) out_degree, count(*) degree from (select from_node_id id, 1 o, 0 i from e union all select to_node_id, 0, 1 from e) group by id)"
_NORM = "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))"
_BLANK = "coalesce(trim({}), '') = ''"

QUERIES = {f.__name__: f for f in (stats_nodes_by_type, stats_edges_by_type, missing_edge_targets, edges_by_type_method, reporting_edges_by_type_method, high_degree_nodes, degree_centrality, edge_type_share, hard_soft_split, missing_evidence_metrics, duplicate_logical_groups, self_loops, near_self_loops, unresolved_reference_summary, unresolved_pattern_buckets, unresolved_samples_ids, exact_edge_dedupe, semi_key_dedupe, parallel_edge_collapse, placeholder_backfill, edge_upsert_latest, orphan_prune, identity_buckets, orphan_nodes, low_confidence_edges)}
ORACLE = {
    "stats_nodes_by_type": twin("select node_type, count(*) n from n group by 1"),
    "stats_edges_by_type": twin("select edge_type, count(*) n from e group by 1"),
    "missing_edge_targets": twin("select edge_type, count(*) n, count(distinct to_node_id) targets from e where not exists (select 1 from n where n.id = to_node_id) group by 1"),
    "edges_by_type_method": twin("select edge_type, source_method, count(*) n, round(avg(confidence), 3) avg_confidence, round(min(confidence), 3) min_confidence, round(max(confidence), 3) max_confidence from e group by 1, 2"),
    "reporting_edges_by_type_method": twin("select edge_type, extraction_method source_method, count(*) n, round(avg(confidence), 3) avg_confidence, round(min(confidence), 3) min_confidence, round(max(confidence), 3) max_confidence from g group by 1, 2"),
    "high_degree_nodes": twin(f"with {_DEG} select t.id, cast(in_degree as bigint) in_degree, cast(out_degree as bigint) out_degree, degree, node_type, title from (select * from dg order by degree desc, id limit 40) t left join n on n.id = t.id"),
    "degree_centrality": twin(f"with {_DEG} select id, degree from dg"),
    "edge_type_share": twin("select edge_type, count(*) n, round(100.0::double * count(*) / sum(count(*)) over (), 2) pct from e group by 1"),
    "hard_soft_split": twin(f"select count(*) filter (source_method in {_HARD}) hard, count(*) filter (source_method not in {_HARD}) soft, count(*) total from e"),
    "missing_evidence_metrics": twin(f"select unnest(['edges', 'no_text', 'no_url', 'no_text_and_url', 'no_confidence', 'hard_without_any', 'no_method']) metric, unnest([count(*), count(*) filter (t), count(*) filter (u), count(*) filter (t and u), count(*) filter (confidence is null), count(*) filter (t and u and source_method in {_HARD}), count(*) filter (source_method is null)]) n from (select *, {_BLANK.format('evidence_text')} t, {_BLANK.format('source_url')} u from e)"),
    "duplicate_logical_groups": twin(f"""select 'nodes_title_text' metric, count(*) groups, coalesce(sum(c - 1), 0)::bigint excess from (select count(*) c from n where trim(coalesce(text, '')) <> '' group by node_type, title, text having count(*) > 1)
        union all select 'nodes_norm_title', count(*), coalesce(sum(c - 1), 0)::bigint from (select count(*) c from n group by node_type, {_NORM} having count(*) > 1)
        union all select 'edges_exact', count(*), coalesce(sum(c - 1), 0)::bigint from (select count(*) c from e group by from_node_id, to_node_id, edge_type, source_method, evidence_text having count(*) > 1)"""),
    "self_loops": twin("select id, from_node_id, edge_type from e where from_node_id = to_node_id"),
    "near_self_loops": seeded("select e.id, from_node_id, to_node_id, edge_type from e join n a on a.id = from_node_id join n b on b.id = to_node_id where from_node_id <> to_node_id and a.node_type = b.node_type and a.title = b.title and a.text = b.text and trim(a.text) <> ''"),
    "unresolved_reference_summary": twin(f"with {_PH} select status, count(*) n from st group by 1"),
    "unresolved_pattern_buckets": twin("""with p as (select id, title, trim(coalesce(title, '')) tt, lower(trim(coalesce(title, '')) || ' ' || coalesce(url, '') || ' ' || coalesce(stable_key, '')) h, node_type, lower(regexp_extract(replace(replace(coalesce(url, ''), 'external:', ''), 'url:', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) host from n where node_type in ('external_reference', 'rule_reference') and json_valid(metadata_json) and lower(metadata_json->>'$.placeholder') in ('true', '1')),
        l as (select to_node_id id, count(*) live from e where edge_type = 'references' group by 1),
        b as (select p.id, title, live, case when node_type = 'rule_reference' and contains(h, 'pra-rules/') then 'Internal rule URL needing resolver context' when contains(h, 'guidance/supervisory-statements') or regexp_matches(h, '\\bss\\d+[-/]\\d+\\b') then 'Supervisory statement reference' when contains(h, 'guidance/statements-of-policy') or regexp_matches(h, '\\bsop\\d*[-/]?\\d*\\b') then 'Statement of policy reference' when lower(tt) in ('here', 'click here') then 'Generic link text' when regexp_matches(lower(tt), '^(https?://|www\\.)') then 'Raw URL title' when regexp_matches(tt, '^(?i:\\d+(\\.\\d+)*[a-z]?([()\\w–-]+)?)$') then 'Bare paragraph/rule number' when regexp_matches(tt, '^(?i:chapter|article|section|annex|appendix|part)\\b') then 'Generic structural label' when host <> '' then 'External site: ' || host else 'Other unresolved pattern' end pattern from p join l on l.id = p.id)
        select pattern, count(*) n, sum(live) live_edges, (select string_agg(title, '|' order by title, id) from (select * from b x where x.pattern = b.pattern order by title, id limit 12)) examples from b group by pattern"""),
    "unresolved_samples_ids": twin(f"with {_PH} select id, title, printf('UR-%04d', row_number() over (order by title, id)) display_id from (select id, title from st where status = 'live' order by title, id limit 40)"),
    "exact_edge_dedupe": twin("select edge_type, count(*) n from (select distinct from_node_id, to_node_id, edge_type, source_method, evidence_text from e) group by 1"),
    "semi_key_dedupe": twin("with k as (select *, coalesce(case when json_valid(metadata_json) then metadata_json->>'$.reference' end, evidence_text) ref from e) select source_method, count(*) n from k where not (source_method like 'regex%' and exists (select 1 from k o where o.source_method in ('html_anchor', 'llm_reference') and o.from_node_id = k.from_node_id and o.to_node_id = k.to_node_id and o.edge_type = k.edge_type and o.ref = k.ref)) group by 1"),
    "parallel_edge_collapse": twin("select from_node_id, to_node_id, edge_type, count(*) n, max(confidence) confidence, arg_min(evidence_text, id) filter (trim(evidence_text) <> '') evidence_text, string_agg(id, ',' order by id) edge_ids from e group by 1, 2, 3"),
    "placeholder_backfill": twin("select to_node_id id, 'external_reference' node_type, coalesce(min(evidence_text) filter (trim(evidence_text) <> ''), to_node_id) title, count(*) n_edges from e where trim(to_node_id) <> '' and not exists (select 1 from n where n.id = to_node_id) group by to_node_id"),
    "edge_upsert_latest": "with o as (select * from edge where loaded_at < timestamp '2025-06-01' qualify row_number() over (partition by id order by loaded_at desc) = 1), w as (select * from edge where loaded_at >= timestamp '2025-06-01' qualify row_number() over (partition by id order by loaded_at desc) = 1) select coalesce(w.id, o.id) id, coalesce(w.edge_type, o.edge_type) edge_type, case when o.id is null then w.source_url else o.source_url end source_url, round(case when w.id is null then o.confidence else w.confidence end, 3) confidence, strftime(case when w.id is null then o.loaded_at else w.loaded_at end, '%Y-%m-%d %H:%M:%S') loaded from o full join w on o.id = w.id",
    "orphan_prune": twin(f"with {_PH} select node_type, count(*) n from n where id not in (select id from st where status = 'orphan') group by 1"),
    "identity_buckets": twin(f"select node_type, {_NORM} norm_title, count(*) n from n group by 1, 2 having count(*) > 1"),
    "orphan_nodes": twin("select node_type, count(*) n from n where not exists (select 1 from e where from_node_id = n.id) and not exists (select 1 from e where to_node_id = n.id) group by 1"),
    "low_confidence_edges": twin("select edge_type, review_status, count(*) n, round(min(confidence), 3) least from g where confidence < 0.75 group by 1, 2"),
}
