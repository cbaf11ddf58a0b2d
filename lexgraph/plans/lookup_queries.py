"""Lookups, derived texts, repairs and named functions over the test tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..operators import lookup as L
from ..operators import store
from ..runtime import table
from .graph import edges, gedges, nodes, seeded, seeded_edges, seeded_nodes, twin


def _spans(s: SparkSession, d: str) -> DataFrame:
    return store.latest(table(s, d, "source_span"), "span_id")


def _sources(s: SparkSession, d: str) -> DataFrame:
    return store.latest(table(s, d, "document_source"), "id")


def _gnodes(s: SparkSession, d: str) -> DataFrame:
    """Nodes of the reporting graph, which the tables give as ends of its edges only."""
    g = gedges(s, d)
    return g.select(F.col("source_node_id").alias("id")).unionByName(g.select(F.col("target_node_id").alias("id"))).where("id is not null").distinct().select("id", F.lit("GraphNode").alias("node_type"), F.col("id").alias("label"))


def point_lookup(s: SparkSession, d: str) -> DataFrame:
    """Every node of both graphs by its id, and some names that only a data item bears."""
    n, g = nodes(s, d), _gnodes(s, d)
    parts = {"rulebook": n.select("id", F.col("node_type").alias("kind"), F.col("title").alias("label")), "reporting": g.select("id", F.col("node_type").alias("kind"), "label")}
    return L.point(parts, n.select("id").unionByName(g.select("id")).distinct())


def node_derived_text(s: SparkSession, d: str) -> DataFrame:
    return L.derived_text(nodes(s, d), edges(s, d))


def parent_chapters(s: SparkSession, d: str) -> DataFrame:
    return L.parent_chapters(seeded_nodes(s, d), seeded_edges(s, d))


def embedding_texts(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d)
    return L.embedding_text(n, L.parent_chapters(n, edges(s, d)))


def adjacent_nodes(s: SparkSession, d: str) -> DataFrame:
    """What the reporting node with most outgoing edges uses or is evidenced by."""
    g = gedges(s, d)
    top = g.groupBy("source_node_id").count().orderBy(F.desc("count"), "source_node_id").first()[0]
    return L.adjacent(g, top, ("USES_TEMPLATE", "EVIDENCED_BY", "HAS_DATAPOINT"))


def relationship_evidence(s: SparkSession, d: str) -> DataFrame:
    return L.edge_evidence(gedges(s, d), _spans(s, d)).select("edge_id", "edge_type", "span_id", "page_number", "heading_path", "quote")


def edge_policy(s: SparkSession, d: str) -> DataFrame:
    return L.with_policy(gedges(s, d)).select("edge_id", "review_status", F.round("confidence", 6).alias("confidence"))


def best_spans(s: SparkSession, d: str) -> DataFrame:
    return L.best_spans(_spans(s, d), ["liquidity", "ledger"], F.coalesce("normalised_text", "raw_text"), "source_id")


def placeholder_targets(s: SparkSession, d: str) -> DataFrame:
    """Placeholders whose address and anchor one node bears; with hand-made records, as the tables have no anchors."""
    seed = s.createDataFrame(_ANCHORS, "id string, node_type string, url string, metadata_json string")
    return L.placeholder_targets(nodes(s, d).select("id", "node_type", "url", "metadata_json").unionByName(seed))


_ANCHORS = [("t1", "rule", "https://r.example/a/01-01-2024#x", '{"html_id": "x1"}'), ("t2", "rule", "https://r.example/b#y", '{"html_id": "y1"}'), ("t3", "rule", "https://r.example/b#z", '{"html_id": "y2"}'), ("t4", "rule", "https://r.example/b", '{"html_id": "y2"}'), ("p1", "rule_reference", "https://r.example/a#x1", "{}"), ("p2", "rule_reference", "https://r.example/b/#y1", "{}"), ("p3", "rule_reference", "https://r.example/b#y2", "{}"), ("p4", "rule_reference", "https://r.example/none#q", "{}")]


def inverted_index(s: SparkSession, d: str) -> DataFrame:
    i = L.inverted_index(nodes(s, d))
    return i.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.min("id").alias("first_id"))


def family_removal(s: SparkSession, d: str) -> DataFrame:
    """What is left of nodes and edges without policy statements and what they contain."""
    n, e = nodes(s, d), edges(s, d)
    top = n.where((F.col("node_type") == "guidance_document") & (F.get_json_object("metadata_json", "$.document_type") == "statement_of_policy")).select("id")
    below = e.where("edge_type = 'contains'").join(top.withColumnRenamed("id", "from_node_id"), "from_node_id", "left_semi").select(F.col("to_node_id").alias("id"))
    left = L.without_family({"node": (n, ["id"]), "edge": (e, ["from_node_id", "to_node_id"])}, top.unionByName(below))
    out = [left[t].groupBy(F.lit(t).alias("table_name"), F.col(c).alias("kind")).agg(F.count("*").alias("n")) for t, c in (("node", "node_type"), ("edge", "edge_type"))]
    return out[0].unionByName(out[1])


def accepted_edges(s: SparkSession, d: str) -> DataFrame:
    """Resolved references that could be new edges of the rulebook: both ends known, not stated yet."""
    r = store.latest(table(s, d, "llm_reference_resolution"), "id").select(F.col("source_node_id").alias("source"), F.col("target_node_id").alias("target"), F.lit("references").alias("edge_type"))
    e = edges(s, d).select(F.col("from_node_id").alias("source_node_id"), F.col("to_node_id").alias("target_node_id"), "edge_type")
    return L.missing_edges(r, nodes(s, d), e)


def metadata_patch(s: SparkSession, d: str) -> DataFrame:
    """One field set in readable metadata of rules; other fields stay, unreadable metadata becomes the field alone."""
    m = F.coalesce(F.from_json("metadata_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    keep = F.map_filter(m, lambda k, v: k != "checked")
    patched = F.map_concat(keep, F.create_map(F.lit("checked"), F.lit("yes")))
    names = F.array_join(F.array_sort(F.map_keys(patched)), ",")
    return nodes(s, d).where("node_type = 'rule'").select("id", names.alias("fields"), patched["checked"].alias("checked"), patched["part_title"].alias("part_title"))


def metadata_objects(s: SparkSession, d: str) -> DataFrame:
    """Whether metadata is an object, another value or unreadable."""
    v = F.try_parse_json("metadata_json")
    kind = F.when(F.col("metadata_json").isNull() | (F.trim("metadata_json") == ""), "empty").when(v.isNull(), "unreadable").when(F.schema_of_variant(v).startswith("OBJECT"), "object").otherwise("value")
    return nodes(s, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def text_keys(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d)
    return n.select("id", X.compact_code(F.col("title")).alias("code"), X.slug(F.col("title")).alias("slug"), X.blank_to_null(F.col("text")).isNull().alias("bare"))


def evidence_windows(s: SparkSession, d: str) -> DataFrame:
    """The first obligation of each text with its surroundings."""
    return nodes(s, d).select("id", X.evidence_window(F.col("text"), r"\bmust\b").alias("window")).where("window is not null")


def file_names(s: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _sources(s, d).select("id", R.cache_name(u).alias("cache_name"), R.safe_name(u).alias("safe_name"), R.canonical_url(u).alias("canonical"), F.substring(F.sha1(R.canonical_url(u)), 1, 16).alias("source_key"))


def labelled_values(s: SparkSession, d: str) -> DataFrame:
    """Confidences given as labels and numbers, template numbers and dates of evidence texts."""
    r = store.latest(table(s, d, "llm_reference_resolution"), "id")
    c = F.col("extracted_confidence")
    label = F.when(c > 0.9, " High ").when(c > 0.7, "medium").when(c > 0.5, c.cast("string")).when(c > 0.4, "LOW").otherwise("none")
    return r.select("id", R.confidence_number(label).alias("confidence"), R.template_number(F.col("target_title_or_identifier")).alias("template"), R.iso_date(F.col("created_at")).alias("created"))


def versions(s: SparkSession, d: str) -> DataFrame:
    """Version marks of URLs; the tables have none, so they are made from the path's number."""
    number = F.regexp_extract("url", r"(\d+)", 1)
    marked = F.concat(F.lit("https://x.example/banking_"), F.substring(number, 1, 1), F.lit(".2."), F.substring(number, 2, 1), F.lit("/doc-v"), number, F.lit(".pdf#a"))
    v = R.package_version(marked)
    return _sources(s, d).where(number != "").select("id", R.document_version(marked).alias("version"), v["major"].alias("major"), v["patch"].alias("patch"), v["hotfix"].alias("hotfix"))


def link_checks(s: SparkSession, d: str) -> DataFrame:
    """Classes of link checks; the statuses are made from the id, as there is no network."""
    n = F.pmod(F.conv(F.substring(F.sha1("id"), 1, 6), 16, 10).cast("int"), F.lit(6))
    status = F.element_at(F.array(F.lit(200), F.lit(403), F.lit(404), F.lit(410), F.lit(500), F.lit(None).cast("int")), n + 1)
    kind = R.link_status(F.col("url"), F.col("url"), status, F.lit(""), F.lit(""))
    return _sources(s, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def page_paragraphs(s: SparkSession, d: str) -> DataFrame:
    """Paragraphs of at least 20 characters of pages: blocks parted by blank lines, their lines without page furniture."""
    p = _spans(s, d).where("span_type = 'page' and length(raw_text) > 0").select("span_id", F.posexplode(F.split("raw_text", r"\n[ \t]*\n")).alias("nth", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: R.page_line(x)), lambda x: x != "")
    return p.select("span_id", "nth", F.array_join(lines, " ").alias("text")).where("length(text) >= 20")


def deliberately_unresolved(s: SparkSession, d: str) -> DataFrame:
    r = store.latest(table(s, d, "llm_reference_resolution"), "id")
    reason = R.unresolved_reason(F.col("target_kind"), F.col("reference_text"), F.col("target_title_or_identifier"), F.col("target_part_or_document"))
    return r.select("id", F.coalesce(reason, F.lit("open")).alias("reason"))


def return_codes(s: SparkSession, d: str) -> DataFrame:
    """Form and template codes that spans name, in their sort order's columns."""
    codes = _spans(s, d).select(F.explode(F.regexp_extract_all("raw_text", F.lit(r"\b(?:form|return) ([A-Z]+-?\d+)"), F.lit(1))).alias("code")).distinct()
    return codes.select("code", *R.return_code(F.col("code")))


def title_links(s: SparkSession, d: str) -> DataFrame:
    """Texts of links without window marks, file types and sizes, each once."""
    found = _sources(s, d).select(F.explode(F.regexp_extract_all("raw_html", F.lit(r"(?i)<a\s[^>]*>([^<]*)</a>"), F.lit(1))).alias("t")).distinct()
    return found.select("t", R.link_title(F.concat("t", F.lit(" (PDF 1.2 MB) opens in a new window"))).alias("title"))


def smoke_invariants(s: SparkSession, d: str) -> DataFrame:
    """Whether what must hold of a loaded graph does: named checks with the count that breaks each."""
    n, e = nodes(s, d), edges(s, d)
    ends = e.select(F.explode(F.array("from_node_id", "to_node_id")).alias("id"))
    checks = [
        n.where("id is null or trim(id) = ''").agg(F.count("*").alias("n")).select(F.lit("nodes_without_id").alias("name"), "n"),
        n.where("node_type in ('topic', 'topic_cluster')").agg(F.count("*").alias("n")).select(F.lit("retired_topics").alias("name"), "n"),
        ends.join(n.select("id"), "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("ends_without_node").alias("name"), "n"),
        n.where(X.is_blank(F.col("url"))).agg(F.count("*").alias("n")).select(F.lit("nodes_without_url").alias("name"), "n"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.select("name", "n", (F.col("n") == 0).alias("holds"))


def duplicate_urls(s: SparkSession, d: str) -> DataFrame:
    """URLs that several documents or sections bear, with who does."""
    url = F.lower(F.regexp_replace(F.trim("url"), "/+$", ""))
    k = seeded_nodes(s, d).where("node_type in ('guidance_document', 'guidance_section', 'part')").select(url.alias("u"), F.concat_ws(":", "node_type", "id").alias("who")).where("u like 'http%'")
    return k.groupBy("u").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("who")), " | ").alias("nodes")).where("n > 1")


def display_titles(s: SparkSession, d: str) -> DataFrame:
    """How nodes and edges are shown: a badge from the document code, a label, a radius by degree, a style by method."""
    n = nodes(s, d)
    code = F.upper(F.regexp_extract("title", r"\b((?:SS|PS|CP|SoP|GS|HN)\s*\d+/\d{2})\b", 1))
    deg = edges(s, d).select(F.explode(F.array("from_node_id", "to_node_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    radius = F.least(F.lit(36.0), F.round(8 + F.sqrt(F.coalesce("degree", F.lit(0)).cast("double")) * 1.8, 3))
    return n.join(deg, "id", "left").select("id", F.nullif(code, F.lit("")).alias("badge"), F.concat_ws(" · ", F.nullif(F.trim("title"), F.lit("")), F.translate("node_type", "_", " ")).alias("label"), radius.alias("radius"))


def graph_filter(s: SparkSession, d: str) -> DataFrame:
    """The view of rules and guidance over stated relations; nodes left without an edge drop out."""
    n = nodes(s, d).where("node_type in ('rule', 'guidance_paragraph', 'chapter')").where(~F.lower(F.concat_ws(" ", "title", "text")).rlike("insur"))
    e = edges(s, d).where("edge_type in ('references', 'amends', 'contains')")
    keep = n.select("id")
    inside = e.join(keep.withColumnRenamed("id", "from_node_id"), "from_node_id", "left_semi").join(keep.withColumnRenamed("id", "to_node_id"), "to_node_id", "left_semi")
    ends = inside.select(F.explode(F.array("from_node_id", "to_node_id")).alias("id")).distinct()
    return n.join(ends, "id", "left_semi").groupBy("node_type").agg(F.count("*").alias("n"))


def relative_roles(s: SparkSession, d: str) -> DataFrame:
    """What the other ends of the best-connected node's edges are to it, and in which direction."""
    e = edges(s, d)
    top = e.select(F.explode(F.array("from_node_id", "to_node_id")).alias("id")).join(nodes(s, d).select("id"), "id", "left_semi").groupBy("id").count().orderBy(F.desc("count"), "id").first()[0]
    near = e.where((F.col("from_node_id") == top) | (F.col("to_node_id") == top))
    out = F.col("from_node_id") == top
    role = F.when(F.col("edge_type") == "contains", F.when(out, "child").otherwise("parent")).when(F.col("edge_type") == "references", F.when(out, "cited").otherwise("citing")).otherwise("related")
    return near.groupBy(role.alias("role"), F.when(out, "out").otherwise("in").alias("direction")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (point_lookup, node_derived_text, parent_chapters, embedding_texts, adjacent_nodes, relationship_evidence, edge_policy, best_spans, placeholder_targets, inverted_index, family_removal, accepted_edges, metadata_patch, metadata_objects, text_keys, evidence_windows, file_names, labelled_values, versions, link_checks, page_paragraphs, deliberately_unresolved, return_codes, title_links, smoke_invariants, duplicate_urls, display_titles, graph_filter, relative_roles)}

_SP = "sp as (select * from source_span qualify row_number() over (partition by span_id order by loaded_at desc) = 1)"
_DS = "ds as (select * from document_source qualify row_number() over (partition by id order by loaded_at desc) = 1)"
_RR = "rr as (select * from llm_reference_resolution qualify row_number() over (partition by id order by loaded_at desc) = 1)"
_GN = "gn as (select distinct id from (select source_node_id id from g union all select target_node_id from g) where id is not null)"
_PATH = "regexp_replace(regexp_replace(coalesce({0}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '')"
_CANON = "lower(regexp_extract(coalesce(url, ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || regexp_replace(substring(coalesce(url, ''), length(regexp_extract(coalesce(url, ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) + 1), '#.*$', '')"
_M = "nullif(case when json_valid(metadata_json) then metadata_json->>'$.{}' end, '')"
_CHAP = "ch as (select e.to_node_id id, min(p.title) chapter from e join n p on p.id = e.from_node_id where e.edge_type = 'contains' and e.source_method = 'site_structure' and p.node_type = 'chapter' group by 1)"
_WS = "trim(regexp_replace({}, '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x0b]+', ' ', 'g'))"
ORACLE = {
    "point_lookup": twin(f"with {_GN} select coalesce(gn.id, n.id) asked, coalesce(gn.id, n.id) id, case when gn.id is not null then 'reporting' else 'rulebook' end source, case when gn.id is not null then 'GraphNode' else n.node_type end kind, case when gn.id is not null then gn.id else n.title end as label from gn full join n on n.id = gn.id"),
    "node_derived_text": twin("with c as (select from_node_id id, title, text, row_number() over (partition by from_node_id order by title, x.id) k from (select distinct from_node_id, to_node_id from e where edge_type = 'contains') e join n x on x.id = e.to_node_id where trim(coalesce(title, '')) <> '' or trim(coalesce(text, '')) <> ''), m as (select id, string_agg(case when trim(coalesce(text, '')) = '' then coalesce(title, '') else coalesce(title, '') || chr(10) || text end, chr(10) || chr(10) order by k) made from c where k <= 30 and id in (select id from n where trim(coalesce(text, '')) = '') group by id) select n.id, coalesce(made, n.text) as text, made is not null derived from n left join m on m.id = n.id"),
    "parent_chapters": seeded(f"with {_CHAP} select id, chapter from ch"),
    "embedding_texts": twin(f"with {_CHAP} select n.id, concat_ws(chr(10), 'PRA Rulebook Part: ' || {_M.format('part_title')}, 'PRA supervisory statement or guidance document: ' || {_M.format('document_title')}, 'Chapter: ' || chapter, case when node_type = 'defined_term' then 'Defined term source: ' || {_M.format('source')} end, 'Node type: ' || coalesce(node_type, ''), 'Title: ' || coalesce(title, ''), nullif(coalesce(text, ''), '')) as text from n left join ch on ch.id = n.id"),
    "adjacent_nodes": twin("with t as (select source_node_id id from g group by 1 order by count(*) desc, 1 limit 1) select target_node_id id, edge_id, edge_type, confidence from g where source_node_id = (select id from t) and edge_type in ('USES_TEMPLATE', 'EVIDENCED_BY', 'HAS_DATAPOINT') order by target_node_id, edge_id limit 100"),
    "relationship_evidence": twin(f"with {_SP} select edge_id, edge_type, span_id, page_number, heading_path, coalesce(normalised_text, raw_text) quote from g left join sp on lower(trim(span_id)) = lower(trim(evidence_span_id))"),
    "edge_policy": twin("select edge_id, case when coalesce(trim(evidence_span_id), '') = '' then 'needs_review' else coalesce(nullif(trim(review_status), ''), 'unreviewed') end review_status, round(case when coalesce(trim(evidence_span_id), '') = '' then least(coalesce(confidence, 0), 0.55::double) else coalesce(confidence, 0) end, 6) confidence from g"),
    "best_spans": f"with {_SP}, r as (select source_id, span_id, lower(coalesce(normalised_text, raw_text, '')) t from sp), k as (select *, case when contains(t, 'liquidity') and contains(t, 'ledger') then 0 when contains(t, 'liquidity') then 1 when contains(t, 'ledger') then 2 end rank from r) select source_id, span_id, rank = 0 all_terms from k where rank is not null qualify row_number() over (partition by source_id order by rank, length(t), span_id) = 1",
    "placeholder_targets": twin("with v as (select id, node_type, url, metadata_json from n union all select * from (values " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in _ANCHORS) + ") v(a, b, c, d)), r as (select id, regexp_replace(split_part(url, '#', 1), '/+$', '') base, " + _M.format("html_id") + " anchor from v where node_type <> 'rule_reference' and url is not null), h as (select id, regexp_replace(split_part(url, '#', 1), '/+$', '') base, regexp_extract(url, '#(.+)$', 1) anchor from v where node_type = 'rule_reference' and contains(url, '#')), x as (select h.id, min(r.id) target_id, count(*) c, 'exact_html_id_url' basis from h join r on r.base = h.base and r.anchor = h.anchor group by h.id), y as (select h.id, min(r.id) target_id, count(*) c, 'dated_html_id_url' basis from h join r on regexp_replace(r.base, '/\\d{2}-\\d{2}-\\d{4}/?$', '') = h.base and regexp_replace(r.base, '/\\d{2}-\\d{2}-\\d{4}/?$', '') <> r.base and r.anchor = h.anchor where h.id not in (select id from x) group by h.id) select id, target_id, basis from (select * from x union all select * from y) where c = 1"),
    "inverted_index": twin("with w as (select id, unnest(list_filter(regexp_split_to_array(lower(concat_ws(' ', title, text)), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) term from n), p as (select term, id, count(*) tf from w group by 1, 2) select term, count(*) df, sum(tf) tf, min(id) first_id from p group by 1"),
    "family_removal": twin(f"with top as (select id from n where node_type = 'guidance_document' and {_M.format('document_type')} = 'statement_of_policy'), dm as (select id from top union select to_node_id from e where edge_type = 'contains' and from_node_id in (select id from top)) select 'node' table_name, node_type kind, count(*) n from n where id not in (select id from dm where id is not null) group by 2 union all select 'edge', edge_type, count(*) from e where from_node_id not in (select id from dm where id is not null) and to_node_id not in (select id from dm where id is not null) group by 2"),
    "accepted_edges": twin(f"with {_RR} select distinct source_node_id source, target_node_id target, 'references' edge_type from rr where trim(source_node_id) <> '' and trim(target_node_id) <> '' and source_node_id in (select id from n) and target_node_id in (select id from n) and not exists (select 1 from e where from_node_id = source_node_id and to_node_id = target_node_id and edge_type = 'references')"),
    "metadata_patch": twin(f"select id, array_to_string(list_sort(list_distinct(list_append(case when json_valid(metadata_json) and json_type(metadata_json) = 'OBJECT' then json_keys(metadata_json) else [] end, 'checked'))), ',') fields, 'yes' checked, case when json_valid(metadata_json) then metadata_json->>'$.part_title' end part_title from n where node_type = 'rule'"),
    "metadata_objects": twin("select case when trim(coalesce(metadata_json, '')) = '' then 'empty' when not json_valid(metadata_json) then 'unreadable' when json_type(metadata_json) = 'OBJECT' then 'object' else 'value' end kind, count(*) n from n group by 1"),
    "text_keys": twin("select id, regexp_replace(upper(title), '[^A-Z0-9]+', '', 'g') code, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') slug, coalesce(trim(text), '') = '' bare from n"),
    "evidence_windows": twin("with f as (select id, text, regexp_extract(text, '(?s)^(.*?)\\bmust\\b', 1) pre from n where regexp_matches(text, '\\bmust\\b')) select id, " + _WS.format("substring(text, greatest(length(pre) + 1 - 90, 1), length(pre) + 1 - greatest(length(pre) + 1 - 90, 1) + 4 + 90)") + ' as "window" from f'),
    "file_names": f"with {_DS}, p as (select id, url, {_PATH.format('url')} p, translate(regexp_extract(coalesce(url, ''), '\\?([^#]*)', 1), '&=', '_-') q, {_CANON} cu from ds), a as (select *, regexp_replace(regexp_replace(p, '^/+|/+$', '', 'g'), '/', '__', 'g') c, case when regexp_extract(p, '([^/]*)/*$', 1) = '' then 'index' else regexp_extract(p, '([^/]*)/*$', 1) end nm, substr(sha1(cu), 1, 16) k from p), b as (select *, lower(regexp_extract(nm, '[^.](\\.[^.]*)$', 1)) en from a), s as (select *, substring(regexp_replace(regexp_replace(case when en <> '' then regexp_replace(nm, '\\.[^.]*$', '') else nm end, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), 1, 110) st from b) select id, case when c = '' then 'index' else c end || case when q <> '' then '__' || q else '' end || '.html' cache_name, case when st <> '' then st else k end || '-' || k || case when en = '' or length(en) > 8 then '.html' else en end safe_name, cu canonical, k source_key from s",
    "labelled_values": f"with {_RR} select id, case when extracted_confidence > 0.9 then 0.9 when extracted_confidence > 0.7 then 0.65 when extracted_confidence > 0.5 then extracted_confidence when extracted_confidence > 0.4 then 0.35 else 0 end::double confidence, case when regexp_matches(t, '^\\d+(\\.\\d+)?$') then regexp_replace(printf('%.6f', t::double), '\\.?0+$', '') else regexp_extract(t, '(\\d+(?:\\.\\d+)*)', 1) end as template, nullif(regexp_extract(coalesce(created_at, ''), '(20\\d{{2}}-\\d{{2}}-\\d{{2}})', 1), '') created from (select *, replace(regexp_replace(trim(coalesce(target_title_or_identifier, '')), '^[A-Za-z_ -]+', ''), '_', '.') t from rr)",
    "versions": f"with {_DS}, x as (select id, regexp_extract(url, '(\\d+)', 1) k from ds) select id, k::int as version, substr(k, 1, 1)::int major, try_cast(substr(k, 2, 1) as int) patch, 0 hotfix from x where k <> '' and length(k) > 1 union all select id, k::int, null, null, null from x where k <> '' and length(k) = 1",
    "link_checks": f"with {_DS}, x as (select ([200, 403, 404, 410, 500, null])[('0x' || substr(sha1(id), 1, 6))::int % 6 + 1] st, lower(regexp_extract({_PATH.format('url')}, '(\\.[A-Za-z0-9]+)$', 1)) en from ds) select case when st is null then 'error' when st = 403 and en in ('.pdf', '.xlsx') then 'ok' when st = 403 and en = '.aspx' then 'broken' when st in (404, 410) then 'broken' when st >= 400 then 'suspect' else 'ok' end kind, count(*) n from x group by 1",
    "page_paragraphs": f"with {_SP}, b as (select span_id, string_split(regexp_replace(raw_text, '\\n[ \\t]*\\n', chr(1), 'g'), chr(1)) bs from sp where span_type = 'page' and length(raw_text) > 0), x as (select span_id, unnest(range(0, len(bs)))::int nth, unnest(bs) block from b), l as (select span_id, nth, array_to_string(list_filter(list_transform(string_split(block, chr(10)), lambda t: case when regexp_matches({_WS.format('t')}, '^\\d+$') or regexp_matches({_WS.format('t')}, '(?i)^PRA\\s+(Supervisory Statement|Statement of Policy)\\b') or regexp_matches({_WS.format('t')}, '(?i)^Bank of England\\s+\\|') then '' else {_WS.format('t')} end), lambda t: t <> ''), ' ') as text from x) select * from l where length(text) >= 20",
    "deliberately_unresolved": f"with {_RR}, x as (select id, trim(regexp_replace(lower(coalesce(target_kind, '')), '[^a-z0-9]+', ' ', 'g')) kind, concat_ws(' ', coalesce(reference_text, ''), coalesce(target_title_or_identifier, ''), coalesce(target_part_or_document, '')) hay from rr), y as (select *, trim(regexp_replace(lower(hay), '[^a-z0-9]+', ' ', 'g')) h from x) select id, case when length(h) <= 2 then 'noisy_fragment' when h in ('pra rulebook', 'part of pra rulebook', 'part of the pra rulebook', 'the pra rulebook', 'crr', 'regulation', 'that regulation', 'this implementing regulation', 'implementing regulation') then 'generic_reference' when regexp_matches(hay, '(?i)\\b(that|this|these|thereof|relevant|applicable)\\b') and regexp_matches(hay, '(?i)\\b(Regulation|Directive|Part|Article|Annex|standard|rule)\\b') then 'relative_reference' when kind in ('unknown', 'reference', 'definition', 'paragraph', 'namespace') then 'low_value_reference' when regexp_matches(h, '^[a-z]?\\(?[a-z0-9]{{1,3}}\\)?$') then 'noisy_fragment' else 'open' end reason from y",
    "return_codes": f"with {_SP}, c as (select distinct unnest(regexp_extract_all(raw_text, '\\b(?:form|return) ([A-Z]+-?\\d+)', 1)) code from sp) select code, regexp_extract(code, '^([A-Z]+)', 1) prefix, coalesce(try_cast(nullif(regexp_extract(code, '^[A-Z]+(\\d*)', 1), '') as bigint), 9007199254740991) number, regexp_extract(code, '^[A-Z]+\\d*(.*)$', 1) suffix from c",
    "title_links": f"with {_DS}, t as (select distinct unnest(regexp_extract_all(raw_html, '(?i)<a\\s[^>]*>([^<]*)</a>', 1)) t from ds) select t, regexp_replace({_WS.format('t')}, '^[ –—-]+|[ –—-]+$', '', 'g') title from t",
    "smoke_invariants": twin("with c as (select 'nodes_without_id' as name, count(*) n from n where id is null or trim(id) = '' union all select 'retired_topics', count(*) from n where node_type in ('topic', 'topic_cluster') union all select 'ends_without_node', count(*) from (select from_node_id id from e union all select to_node_id from e) x where not exists (select 1 from n where n.id = x.id) union all select 'nodes_without_url', count(*) from n where coalesce(trim(url), '') = '') select name, n, n = 0 holds from c"),
    "duplicate_urls": seeded("with k as (select lower(regexp_replace(trim(url), '/+$', '')) u, node_type || ':' || id who from n where node_type in ('guidance_document', 'guidance_section', 'part')) select u, count(*) n, string_agg(who, ' | ' order by who) nodes from k where u like 'http%' group by 1 having count(*) > 1"),
    "display_titles": twin("with d as (select id, count(*) degree from (select from_node_id id from e union all select to_node_id from e) group by 1) select n.id, nullif(upper(regexp_extract(title, '\\b((?:SS|PS|CP|SoP|GS|HN)\\s*\\d+/\\d{2})\\b', 1)), '') badge, concat_ws(' · ', nullif(trim(title), ''), replace(node_type, '_', ' ')) as label, least(36.0::double, round(8 + sqrt(coalesce(degree, 0)::double) * 1.8::double, 3)) radius from n left join d on d.id = n.id"),
    "graph_filter": twin("with k as (select * from n where node_type in ('rule', 'guidance_paragraph', 'chapter') and not contains(lower(concat_ws(' ', title, text)), 'insur')), i as (select from_node_id f, to_node_id t from e where edge_type in ('references', 'amends', 'contains') and from_node_id in (select id from k) and to_node_id in (select id from k)) select node_type, count(*) n from k where id in (select f from i union select t from i) group by 1"),
    "relative_roles": twin("with h as (select id from (select from_node_id id from e union all select to_node_id from e) where id in (select id from n) group by 1 order by count(*) desc, 1 limit 1) select case edge_type when 'contains' then case when from_node_id = h.id then 'child' else 'parent' end when 'references' then case when from_node_id = h.id then 'cited' else 'citing' end else 'related' end as role, case when from_node_id = h.id then 'out' else 'in' end direction, count(*) n from e, h where from_node_id = h.id or to_node_id = h.id group by 1, 2"),
}
