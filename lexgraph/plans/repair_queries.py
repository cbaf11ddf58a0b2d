"""Repairs of references, searches with a type order, containment joins and maps of articles, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_words
from ..operators import repair as P
from ..operators import semantic as M
from ..operators import store
from ..runtime import table
from ..sources import rulebook
from .analysis_queries import ORACLE as _ANALYSIS
from .graph import edges, gedges, nodes, twin

_PAGE = '<p>See <a href="/pra-rules/b#abc123">Target 4.2</a>, <a href="/pra-rules/c#x1">Twice</a> and <a href="/pra-rules/c#x2">Twice</a>.</p>'
_LINKS = [
    ("l1", "s", "part-b", "Target 4.2", "https://r.example/pra-rules/a/01-06-2026", '{"href": "https://r.example/pra-rules/b"}'),
    ("l2", "s", "part-c", "Twice", "https://r.example/pra-rules/a/01-06-2026", '{"href": "https://r.example/pra-rules/c"}'),
    ("l3", "s", "x", "(c)", "https://r.example/pra-rules/a/01-06-2026", '{"href": "https://r.example/guidance/d#def456"}'),
    ("l4", "s", "y", "Open", "https://r.example/pra-rules/a/01-06-2026", '{"href": "https://r.example/pra-rules/e#zzz"}'),
]
_TARGETS = [("t1", '{"html_id": "abc123"}'), ("t2", '{"html_id": "def456"}'), ("t3", '{"html_id": "def456"}'), ("s", '{"html_id": "src"}')]


def _links(s: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = s.createDataFrame(_LINKS, "id string, from_node_id string, to_node_id string, evidence_text string, source_url string, metadata_json string").withColumn("edge_type", F.lit("references")).withColumn("source_method", F.lit("html_link"))
    return e, s.createDataFrame(_TARGETS, "id string, metadata_json string"), s.createDataFrame([("https://r.example/pra-rules/a/01-06-2026", _PAGE)], "url string, raw_html string")


def anchor_resolution(s: SparkSession, d: str) -> DataFrame:
    """Links of the tables and hand-made ones resolved by anchors of nodes and cached pages."""
    e, n, p = _links(s)
    own = edges(s, d).select(*e.columns)
    return P.resolve_anchors(own.unionByName(e), nodes(s, d).select("id", "metadata_json").unionByName(n), table(s, d, "document_source").select("url", "raw_html").unionByName(p))


def anchor_placeholders(s: SparkSession, d: str) -> DataFrame:
    e, n, p = _links(s)
    return P.anchor_placeholders(e, P.resolve_anchors(e, n, p))


def typed_reference_edges(s: SparkSession, d: str) -> DataFrame:
    """Resolved references as typed edges; the tables' target types stand for those of the reporting graph."""
    r = store.latest(table(s, d, "llm_reference_resolution"), "id")
    kind = F.when(F.col("target_kind") == "form", "Template").when(F.col("target_kind") == "guidance", "SourceDocument").when(F.col("target_kind") == "unknown", "ExternalReference").otherwise("Rule")
    return P.typed_edges(r.select(F.col("source_node_id").alias("source"), F.col("target_node_id").alias("target"), kind.alias("target_type"), F.lit(0.9).alias("score"), F.col("extracted_confidence").alias("extracted")))


def materialised_references(s: SparkSession, d: str) -> DataFrame:
    r = store.latest(table(s, d, "llm_reference_resolution"), "id")
    return P.materialised(r.select(norm_words(F.coalesce("target_title_or_identifier", F.lit(""))).alias("key"), F.col("source_node_id").alias("source"), F.col("reference_text").alias("text")))


def site_roots(s: SparkSession, d: str) -> DataFrame:
    """The Part, document, glossary and list that each cached page gives."""
    n, _ = rulebook.read_site(store.latest(table(s, d, "document_source"), "id"))
    return n.where("node_type in ('part', 'guidance_document', 'glossary', 'legal_instruments_index')").select("id", "node_type", "stable_key")


def reporting_search(s: SparkSession, d: str) -> DataFrame:
    """Nodes that name a word, documents first, then sections, paragraphs, rules (a page of fixed length)."""
    order = F.when(F.col("node_type") == "guidance_document", 0).when(F.col("node_type") == "guidance_section", 1).when(F.col("node_type") == "guidance_paragraph", 2).when(F.col("node_type") == "rule", 3).otherwise(9)
    hit = nodes(s, d).where(F.contains(F.lower(F.concat_ws(" ", "id", "title", "text")), F.lit("liquidity")))
    return hit.select("id", "node_type", order.alias("k"), F.lower("title").alias("t")).orderBy("k", "t", "id").limit(80).select("id", "node_type")


def similar_layer(s: SparkSession, d: str) -> DataFrame:
    """The similarity layer: unordered pairs among the five nearest of the stated queries, from a cosine of 0.3."""
    v = table(s, d, "embeddings")
    near = M.similar(v, v.where("vec_id % 100 = 0"), 5, 0.3)
    pair = near.groupBy(F.least("query", "other").alias("a"), F.greatest("query", "other").alias("b")).agg(F.max("cosine").alias("confidence"))
    return pair.select("a", "b", "confidence", F.format_string("cosine=%.3f", "confidence").alias("evidence"))


def article_map_edges(s: SparkSession, d: str) -> DataFrame:
    """Weights between chapters and sections by the edges of what they contain."""
    e = edges(s, d)
    c = nodes(s, d).where("node_type in ('chapter', 'guidance_section', 'guidance_document')").select(F.col("id").alias("from_node_id"))
    member = e.where("edge_type = 'contains'").join(c, "from_node_id", "left_semi").groupBy(F.col("to_node_id").alias("id")).agg(F.min("from_node_id").alias("container"))
    return M.container_weights(e, member)


def part_mentions(s: SparkSession, d: str) -> DataFrame:
    """Titles that hold a Part's name or are held by it; the Parts are few and blocked by their first word."""
    n = nodes(s, d)
    k = n.select("id", "node_type", norm_words(F.col("title")).alias("t")).where("t <> ''")
    parts = k.where("node_type = 'part'").select(F.col("id").alias("part_id"), F.col("t").alias("p"), F.split("t", " ")[0].alias("w"))
    words = k.where("node_type <> 'part'").withColumn("w", F.explode(F.array_distinct(F.split("t", " "))))
    return words.join(parts, "w").where(F.contains("t", F.col("p")) | F.contains("p", F.col("t"))).select("id", "part_id").distinct()


def key_coverage(s: SparkSession, d: str) -> DataFrame:
    """Nodes of the reporting graph whose id no rulebook node bears, and the other way round, without regard to case."""
    g = gedges(s, d)
    r = g.select(F.col("source_node_id").alias("id")).unionByName(g.select(F.col("target_node_id").alias("id"))).select(F.upper(F.regexp_replace("id", "^gn:", "")).alias("k")).distinct()
    n = nodes(s, d).select(F.upper("id").alias("k")).distinct()
    left = [r.join(n, "k", "left_anti").agg(F.count("*").alias("n")).select(F.lit("reporting_only").alias("side"), "n"), n.join(r, "k", "left_anti").agg(F.count("*").alias("n")).select(F.lit("rulebook_only").alias("side"), "n")]
    return left[0].unionByName(left[1])


QUERIES = {f.__name__: f for f in (anchor_resolution, anchor_placeholders, typed_reference_edges, materialised_references, site_roots, reporting_search, similar_layer, article_map_edges, part_mentions, key_coverage)}


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


_RR = "rr as (select * from llm_reference_resolution qualify row_number() over (partition by id order by loaded_at desc) = 1)"
_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_PATHS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/\\d{{2}}-\\d{{2}}-\\d{{4}}/?$', ''), '^/+|/+$', '', 'g')"
_ANCHORS = f"lk as (select * from (values {_values(_LINKS)}) v(id, f, t, ev, su, m)), nd as (select id, case when json_valid(metadata_json) then metadata_json->>'$.html_id' end a from n union all select a, b->>'$.html_id' from (values {_values(_TARGETS)}) v(a, b)), li as (select id, f, t, trim(ev) ev, su, m->>'$.href' href, regexp_extract(m->>'$.href', '#(.+)$', 1) own from lk), pg as (select '{_LINKS[0][4]}' page, {_PATHS.format('h')} p, regexp_extract(h, '#(.+)$', 1) a, x from (select unnest(regexp_extract_all(t, 'href=\"([^\"]*)\">([^<]*)</a>', 1)) h, unnest(regexp_extract_all(t, 'href=\"([^\"]*)\">([^<]*)</a>', 2)) x from (select '{_PAGE}' t))), un as (select page, p, x, min(a) a from pg group by 1, 2, 3 having count(distinct a) = 1), mt as (select li.id, f, t, case when own <> '' then own else un.a end a, case when own <> '' then 'link_anchor' else 'source_html_href' end basis from li left join un on own = '' and un.page = su and un.p = {_PATHS.format('href')} and un.x = ev), rs as (select mt.id replaces_edge_id, f from_node_id, min(nd.id) to_node_id, mt.a anchor, basis, any_value(t) t from mt join nd on nd.a = mt.a and mt.a <> '' group by mt.id, f, mt.a, basis)"
ORACLE = {
    "anchor_resolution": twin(f"with {_ANCHORS} select replaces_edge_id, from_node_id, to_node_id, anchor, basis, 0.98 confidence from rs where to_node_id <> from_node_id and to_node_id <> t"),
    "anchor_placeholders": twin(f"with {_ANCHORS}, x as (select id, f, ev, regexp_extract(href, '^https?://[^/]+/(pra-rules/[^#?]+)#([A-Za-z0-9]+)', 1) p, regexp_extract(href, '^https?://[^/]+/(pra-rules/[^#?]+)#([A-Za-z0-9]+)', 2) a from li where id not in (select replaces_edge_id from rs)) select id replaces_edge_id, f from_node_id, 'url:' || p || '#' || a target_key, substr(sha1('url:' || p || '#' || a), 1, 16) node_id, ev title, 0.55 confidence from x where p <> ''"),
    "typed_reference_edges": f"with {_RR} select source_node_id source, target_node_id target, case target_kind when 'form' then 'REFERENCES_TEMPLATE' when 'guidance' then 'REFERENCES_SOURCE' when 'unknown' then 'REFERENCES_EXTERNAL' else 'REFERENCES_RULE' end edge_type, round(max(least(0.93::double, 0.9::double * extracted_confidence)), 6) confidence from rr where trim(target_node_id) <> '' and extracted_confidence >= 0.72 group by 1, 2, 3",
    "materialised_references": f"with {_RR}, k as (select {_NORM.format(chr(99) + 'oalesce(target_title_or_identifier, ' + chr(39) * 2 + ')')} k, source_node_id s, reference_text t from rr), a as (select k, count(*) n, count(distinct s) sources from k where k <> '' group by 1), x as (select k, string_agg(t, ' | ' order by t) examples from (select *, row_number() over (partition by k order by t) r from (select distinct k, t from k)) where r <= 5 group by k) select a.k as key, 'ref:' || substr(sha1(a.k), 1, 16) node_id, n, sources, examples from a join x on x.k = a.k where sources >= 2",
    "site_roots": f"with ds as (select * from document_source qualify row_number() over (partition by id order by loaded_at desc) = 1), k as (select distinct case source_type when 'part' then 'part' when 'guidance' then 'guidance_document' when 'glossary' then 'glossary' else 'legal_instruments_index' end node_type, case source_type when 'part' then 'part:' || trim(regexp_replace(url, '^https?://[^/?#]*', ''), '/') when 'guidance' then 'guidance_document:' || trim(regexp_replace(url, '^https?://[^/?#]*', ''), '/') when 'glossary' then 'glossary' else 'legal_instruments' end stable_key from ds where source_type in ('part', 'guidance', 'glossary', 'instrument') and url <> '' and raw_html <> '') select substr(sha1(stable_key), 1, 16) id, node_type, stable_key from k",
    "reporting_search": twin("select id, node_type from n where contains(lower(concat_ws(' ', id, title, text)), 'liquidity') order by case node_type when 'guidance_document' then 0 when 'guidance_section' then 1 when 'guidance_paragraph' then 2 when 'rule' then 3 else 9 end, lower(title), id limit 80"),
    "similar_layer": "with p as (select q.vec_id q, x.vec_id o, round(list_cosine_similarity(q.embedding::double[], x.embedding::double[]), 6) c from embeddings q, embeddings x where q.vec_id % 100 = 0 and q.vec_id <> x.vec_id), k as (select * from p where c >= 0.3 qualify row_number() over (partition by q order by c desc, o) <= 5) select least(q, o) a, greatest(q, o) b, max(c) confidence, printf('cosine=%.3f', max(c)) evidence from k group by 1, 2",
    "part_mentions": twin(f"with k as (select id, node_type, {_NORM.format('title')} t from n) select distinct k.id, p.id part_id from k join k p on p.node_type = 'part' and k.node_type <> 'part' and k.t <> '' and list_contains(string_split(k.t, ' '), split_part(p.t, ' ', 1)) and (contains(k.t, p.t) or contains(p.t, k.t))"),
    "key_coverage": twin("with r as (select distinct upper(regexp_replace(id, '^gn:', '')) k from (select source_node_id id from g union all select target_node_id from g)), m as (select distinct upper(id) k from n) select 'reporting_only' side, count(*) n from r where k not in (select k from m) and k is not null union all select 'rulebook_only', count(*) from m where k not in (select k from r where k is not null)"),
}
# The map of articles is that of all containers but for who may contain.
ORACLE["article_map_edges"] = _ANALYSIS["container_edge_weights"].replace("max(from_node_id) container from e where edge_type = 'contains'", "min(from_node_id) container from e where edge_type = 'contains' and from_node_id in (select id from n where node_type in ('chapter', 'guidance_section', 'guidance_document'))")
