"""Reporting queries over a projection of the star schema: nations are data items, brands templates, parts
datapoints, suppliers source documents; plus the stateful queries over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import reporting as R
from ..operators import store
from ..runtime import table
from .graph import nodes


def report_edges(s: SparkSession, d: str) -> DataFrame:
    """source, edge_type, target of the projected reporting graph."""
    li = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    part, sup = table(s, d, "part").select("p_partkey", "p_brand"), table(s, d, "supplier").select("s_suppkey", "s_nationkey")
    cust = table(s, d, "customer").select("c_custkey", "c_nationkey")
    orders = table(s, d, "orders").select("o_orderkey", "o_custkey")
    item = lambda c: F.concat(F.lit("item:"), F.col(c))
    doc = lambda c: F.concat(F.lit("doc:"), F.col(c))
    point = lambda c: F.concat(F.lit("point:"), F.col(c))
    brand = F.concat(F.lit("template:"), F.col("p_brand"))
    uses = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct().join(cust, F.col("o_custkey") == F.col("c_custkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).select(item("c_nationkey").alias("source"), F.lit("USES_TEMPLATE").alias("edge_type"), brand.alias("target"))
    has = part.select(brand.alias("source"), F.lit("HAS_DATAPOINT").alias("edge_type"), point("p_partkey").alias("target"))
    evidence = sup.select(item("s_nationkey").alias("source"), F.lit("EVIDENCED_BY").alias("edge_type"), doc("s_suppkey").alias("target"))
    refs = li.select(doc("l_suppkey").alias("source"), F.lit("REFERENCES_RULE").alias("edge_type"), point("l_partkey").alias("target"))
    return uses.unionByName(has).unionByName(evidence).unionByName(refs).distinct()


def _items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").select(F.concat(F.lit("item:"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("label"))


def _templates(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.concat(F.lit("template:"), F.col("p_brand")).alias("id")).distinct()


def returns_list(s: SparkSession, d: str) -> DataFrame:
    return R.typed_counts(_items(s, d), report_edges(s, d), {"n_templates": "USES_TEMPLATE", "n_documents": "EVIDENCED_BY"})


def templates_list(s: SparkSession, d: str) -> DataFrame:
    e = report_edges(s, d)
    points = e.where("edge_type = 'HAS_DATAPOINT'").select(F.col("source").alias("id"), F.col("target").alias("other"))
    users = e.where("edge_type = 'USES_TEMPLATE'").select(F.col("target").alias("id"), F.col("source").alias("other"))
    return R.branch_counts(_templates(s, d), {"n_datapoints": points, "n_returns": users})


def returns_relying_on(s: SparkSession, d: str) -> DataFrame:
    return R.relying_on(report_edges(s, d), "EVIDENCED_BY", "REFERENCES_RULE")


def return_reference_summary(s: SparkSession, d: str) -> DataFrame:
    rel = R.relying_on(report_edges(s, d), "EVIDENCED_BY", "REFERENCES_RULE")
    return rel.groupBy("source").agg(F.count("*").alias("n_targets"))


def datapoint_search(s: SparkSession, d: str) -> DataFrame:
    """Datapoints found by text in any column, with their template and the number of documents that refer to them."""
    from ..functions.text import contains_any

    p = table(s, d, "part").where(contains_any([F.col("p_name"), F.col("p_type"), F.col("p_brand")], "brand#1"))
    refs = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_suppkey").alias("n_documents"))
    return p.join(refs, "p_partkey", "left").select("p_partkey", "p_name", "p_brand", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def datapoint_groups(s: SparkSession, d: str) -> DataFrame:
    return R.grouped_samples(table(s, d, "part").select("p_brand", "p_name"), "p_brand", "p_name")


def latest_version_docs(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "source", "doc_type", "published_at").where("published_at is not null")
    fam = F.concat_ws("|", F.coalesce("source", F.lit("")), F.coalesce("doc_type", F.lit("")))
    return R.newest_of_family(docs.withColumn("family", fam), "family", "published_at").select("doc_id", "family")


def templates_without_datapoints(s: SparkSession, d: str) -> DataFrame:
    big = report_edges(s, d).where("edge_type = 'HAS_DATAPOINT'").join(table(s, d, "part").where("p_size >= 49").select(F.concat(F.lit("point:"), F.col("p_partkey")).alias("target")), "target", "left_semi")
    return R.without_edge(_templates(s, d), big, "HAS_DATAPOINT")


def data_items_without_edge(s: SparkSession, d: str) -> DataFrame:
    rich = report_edges(s, d).join(table(s, d, "supplier").where("s_acctbal > 9000").select(F.concat(F.lit("doc:"), F.col("s_suppkey")).alias("target")), "target", "left_semi")
    return R.without_edge(_items(s, d), rich, "EVIDENCED_BY")


def or_join_source_docs(s: SparkSession, d: str) -> DataFrame:
    """References that name a node by its id or by its title: an OR made an equi-join over exploded keys."""
    refs = store.latest(table(s, d, "llm_reference_resolution"), "id").select("id", "target_node_id", "target_title")
    n = nodes(s, d)
    names = n.select("id", "title").select(F.explode(F.array(F.col("id"), F.col("title"))).alias("name")).where("name is not null").distinct()
    hit = store.or_join(refs, [F.expr("nullif(target_node_id, '')"), F.expr("nullif(target_title, '')")], names, "name", "id")
    return hit.select("id", "name")


def json_each_keys(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d).select("node_type", F.to_json(F.try_parse_json("metadata_json")).alias("j"))
    return n.select("node_type", F.explode(F.json_object_keys("j")).alias("key")).groupBy("node_type", "key").agg(F.count("*").alias("n"))


def event_latest_state(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    last = F.max_by(F.struct("event_type", "event_id", "value"), F.struct("ts", "event_id"))
    return e.groupBy("user_id").agg(last.alias("e"), F.count("*").alias("n")).select("user_id", F.col("e.event_type").alias("state"), F.col("e.event_id").alias("event_id"), "n")


def event_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions of a user: events without a gap of more than half an hour."""
    e = table(s, d, "events").select("user_id", "ts", "event_id")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.lag("ts").over(w).isNull() | (F.col("ts") > F.lag("ts").over(w) + F.expr("interval 30 minutes")), 1).otherwise(0)
    e = e.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).select("user_id", "session", "n", "first_id")


def event_hourly(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "total")


QUERIES = {f.__name__: f for f in (returns_list, templates_list, returns_relying_on, return_reference_summary, datapoint_search, datapoint_groups, latest_version_docs, templates_without_datapoints, data_items_without_edge, or_join_source_docs, json_each_keys, event_latest_state, event_sessions, event_hourly)}
_RE = """with re as (select distinct 'item:' || c_nationkey source, 'USES_TEMPLATE' edge_type, 'template:' || p_brand target from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey
union select 'template:' || p_brand, 'HAS_DATAPOINT', 'point:' || p_partkey from part union select 'item:' || s_nationkey, 'EVIDENCED_BY', 'doc:' || s_suppkey from supplier union select 'doc:' || l_suppkey, 'REFERENCES_RULE', 'point:' || l_partkey from lineitem) """
ORACLE = {
    "returns_list": _RE + "select 'item:' || n_nationkey id, n_name as label, count(distinct case when edge_type = 'USES_TEMPLATE' then target end) n_templates, count(distinct case when edge_type = 'EVIDENCED_BY' then target end) n_documents from nation left join re on source = 'item:' || n_nationkey group by 1, 2",
    "templates_list": _RE + "select id, (select count(*) from re where edge_type = 'HAS_DATAPOINT' and source = id) n_datapoints, (select count(*) from re where edge_type = 'USES_TEMPLATE' and target = id) n_returns from (select distinct 'template:' || p_brand id from part)",
    "returns_relying_on": _RE + "select b.target, a.source, string_agg(distinct a.target, ',' order by a.target) via from re a join re b on a.target = b.source where a.edge_type = 'EVIDENCED_BY' and b.edge_type = 'REFERENCES_RULE' group by 1, 2",
    "return_reference_summary": _RE + "select a.source, count(distinct b.target) n_targets from re a join re b on a.target = b.source where a.edge_type = 'EVIDENCED_BY' and b.edge_type = 'REFERENCES_RULE' group by 1",
    "datapoint_search": "select p_partkey, p_name, p_brand, (select count(distinct l_suppkey) from lineitem where l_partkey = p_partkey) n_documents from part where contains(lower(p_name), 'brand#1') or contains(lower(p_type), 'brand#1') or contains(lower(p_brand), 'brand#1')",
    "datapoint_groups": "select p_brand, count(*) n, array_to_string(list_sort(list_distinct(list(p_name)))[1:8], '|') samples from part group by 1",
    "latest_version_docs": "with f as (select doc_id, coalesce(source, '') || '|' || coalesce(doc_type, '') family, published_at from documents where published_at is not null) select doc_id, family from f qualify published_at = max(published_at) over (partition by family)",
    "templates_without_datapoints": "select 'template:' || p_brand id from part group by p_brand having count(*) filter (p_size >= 49) = 0",
    "data_items_without_edge": "select 'item:' || n_nationkey id, n_name as label from nation where not exists (select 1 from supplier where s_nationkey = n_nationkey and s_acctbal > 9000)",
    "or_join_source_docs": "with r as (select * from llm_reference_resolution qualify row_number() over (partition by id order by loaded_at desc) = 1), nm as (select distinct name from (select id as name from node union all select title from node) where name is not null) select distinct r.id, nm.name from r join nm on nm.name = nullif(r.target_node_id, '') or nm.name = nullif(r.target_title, '')",
    "json_each_keys": "with l as (select * from node qualify row_number() over (partition by id order by loaded_at desc) = 1), k as (select node_type, unnest(json_keys(case when json_valid(metadata_json) and json_type(metadata_json) = 'OBJECT' then metadata_json end)) as key from l) select node_type, key, count(*) n from k group by 1, 2",
    "event_latest_state": "select user_id, arg_max(event_type, {'a': ts, 'b': event_id}) state, arg_max(event_id, {'a': ts, 'b': event_id}) event_id, count(*) n from events group by 1",
    "event_sessions": "with g as (select *, case when lag(ts) over w is null or ts > lag(ts) over w + interval 30 minutes then 1 else 0 end nw from events window w as (partition by user_id order by ts, event_id)), q as (select *, sum(nw) over (partition by user_id order by ts, event_id) as sess from g) select user_id, sess::bigint as session, count(*) n, min(event_id) first_id from q group by 1, 2",
    "event_hourly": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, event_type, count(*) n, round(sum(value), 2) total from events group by 1, 2",
}
