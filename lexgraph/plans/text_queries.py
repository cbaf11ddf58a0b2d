"""Search, canonical choice, extraction and repair queries over texts, sources and the rulebook graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.ids import hashed_id
from ..operators import canonical as C
from ..operators import enrich as E
from ..operators import search as S
from ..operators import store
from ..operators.quality import top_degree
from ..runtime import TABLES, registered, table
from .graph import edges, gedges, nodes, seeded, seeded_nodes, twin

QUERY = "stressed ledger"


def schema_catalog(s: SparkSession, d: str) -> DataFrame:
    """Column count and rows of every table of the registry."""
    out = None
    for t in TABLES:
        df = table(s, d, t)
        row = df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), F.lit(len(df.columns)).alias("n_columns"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


def table_rows_search(s: SparkSession, d: str) -> DataFrame:
    return S.table_rows(registered(s, d, "document_source"), "audit").select("id", "url")


def list_nodes_page(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d).where("node_type in ('rule', 'guidance_paragraph')").select("id", "node_type", "title")
    return S.page(n, [F.lower("title"), F.col("id")], 50, 20)


def unified_nodes_page(s: SparkSession, d: str) -> DataFrame:
    g = gedges(s, d)
    ends = g.select(F.col("source_node_id").alias("id")).unionByName(g.select(F.col("target_node_id").alias("id"))).distinct()
    parts = [nodes(s, d).select(F.lit("rulebook").alias("source"), "id", F.lower("title").alias("label")), ends.select(F.lit("reporting").alias("source"), "id", F.col("id").alias("label"))]
    return S.merged_page(parts, [F.col("label"), F.col("source"), F.col("id")], 100, 30)


def unified_edges_page(s: SparkSession, d: str) -> DataFrame:
    """Edges of the best-connected node in both directions: two equality filters, not an OR."""
    e = edges(s, d)
    hub = top_degree(e, nodes(s, d), 1).first()["id"]
    both = e.where(F.col("from_node_id") == hub).unionByName(e.where((F.col("to_node_id") == hub) & (F.col("from_node_id") != hub)))
    return S.page(both.select("id", "from_node_id", "to_node_id", "edge_type"), [F.col("edge_type"), F.col("id")], 200)


def search_ilike(s: SparkSession, d: str) -> DataFrame:
    return nodes(s, d).where(X.contains_any([F.col("title"), F.col("text")], QUERY)).select("id", "node_type")


def snippets(s: SparkSession, d: str) -> DataFrame:
    hit = nodes(s, d).where(X.contains_any([F.col("text")], QUERY))
    return hit.select("id", X.snippet(F.col("text"), QUERY).alias("snippet"))


def search_bm25(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d)
    keep = C.canonical_nodes(n, edges(s, d)).where("is_canonical = 1").select("id")
    return S.bm25(n, QUERY).join(keep, "id", "left_semi").orderBy("score", "id").limit(25)


def unified_search(s: SparkSession, d: str) -> DataFrame:
    ranked = S.bm25(nodes(s, d), QUERY).select(F.lit("rulebook").alias("source"), "id", "score")
    other = gedges(s, d).where(X.contains_any([F.col("edge_type")], "template")).select(F.lit("reporting").alias("source"), F.col("edge_id").alias("id"), F.lit(-1.0).alias("score"))
    return S.merged_page([ranked, other], [F.col("score"), F.col("source"), F.col("id")], 60)


def canonical_documents(s: SparkSession, d: str) -> DataFrame:
    return C.document_rank(table(s, d, "canonical_guidance_document")).select("id", "rank")


def canonical_paragraphs(s: SparkSession, d: str) -> DataFrame:
    return C.canonical_nodes(nodes(s, d), edges(s, d)).where("node_type like 'guidance%'").select("id", "is_canonical", "reason")


def canonical_reason_counts(s: SparkSession, d: str) -> DataFrame:
    return C.canonical_nodes(nodes(s, d), edges(s, d)).groupBy("node_type", "reason").agg(F.count("*").alias("n"))


def _users(s: SparkSession, d: str) -> DataFrame:
    return nodes(s, d).where("node_type in ('rule', 'guidance_paragraph')").select("id")


def shared_term_edges(s: SparkSession, d: str) -> DataFrame:
    return E.shared_target_edges(edges(s, d), _users(s, d), "uses_defined_term", 2, 25)


def shared_obligation_edges(s: SparkSession, d: str) -> DataFrame:
    return E.shared_target_edges(edges(s, d), _users(s, d), "has_obligation_pattern", 2, 18)


def rollup_child_edges(s: SparkSession, d: str) -> DataFrame:
    return E.child_edges_on_container(edges(s, d), ("uses_defined_term", "references", "has_obligation_pattern")).withColumn("confidence", F.round("confidence", 6))


def _obligations(s: SparkSession, d: str) -> DataFrame:
    return E.obligations(nodes(s, d)).select("id", "nth", "modal", "action", E.normalised_object(F.col("object")).alias("object"))


def regex_obligations(s: SparkSession, d: str) -> DataFrame:
    return _obligations(s, d)


def obligation_patterns(s: SparkSession, d: str) -> DataFrame:
    o = _obligations(s, d).where("length(object) >= 3")
    key = F.concat_ws(":", "modal", "action", "object")
    return o.groupBy(key.alias("pattern")).agg(F.countDistinct("id").alias("n_nodes"), F.min("id").alias("first_id"))


def regex_rule_references(s: SparkSession, d: str) -> DataFrame:
    """References that texts state, of every scope."""
    return E.text_references(seeded_nodes(s, d)).select("from_id", "to_id", "scope", "reference", "confidence")


def legal_citations(s: SparkSession, d: str) -> DataFrame:
    return E.legal_citations(nodes(s, d))


def title_match_edges(s: SparkSession, d: str) -> DataFrame:
    """Nodes that bear the title of a Part, matched to the first such Part."""
    n = seeded_nodes(s, d)
    parts = n.where("node_type = 'part'").groupBy(X.clean_text(F.lower("title")).alias("t")).agg(F.min("id").alias("part_id"))
    return n.where("node_type <> 'part'").select("id", X.clean_text(F.lower("title")).alias("t")).join(parts, "t").select("id", "part_id")


def quant_thresholds(s: SparkSession, d: str) -> DataFrame:
    """Quantitative limits in the texts of nodes and spans."""
    spans = store.latest(table(s, d, "source_span"), "span_id").select(F.col("span_id").alias("id"), F.coalesce("normalised_text", "raw_text").alias("text"))
    return E.thresholds(nodes(s, d).select("id", "text").unionByName(spans)).select("id", "snippet", "kinds", "found")


def quant_threshold_review(s: SparkSession, d: str) -> DataFrame:
    """Limits said in the same words by several nodes of one type."""
    n = nodes(s, d)
    found = E.thresholds(n).join(n.select("id", "node_type"), "id")
    return E.grouped_thresholds(found, ["node_type"])


def monetary_thresholds(s: SparkSession, d: str) -> DataFrame:
    """Sentences with money of rules and guidance, with stable ids, the decision and display ids."""
    n = nodes(s, d).where("node_type in ('rule', 'guidance_paragraph', 'guidance_document')")
    return E.monetary_candidates(n).select("candidate", "id", "amounts", "decision", "cue")


def evidence_backfill(s: SparkSession, d: str) -> DataFrame:
    return E.backfill_evidence(edges(s, d), nodes(s, d))


def _aliases(s: SparkSession, d: str) -> DataFrame:
    p = nodes(s, d).where("node_type = 'guidance_paragraph' and trim(text) <> ''").select("id", "title", "text")
    first = F.min("id").over(W.partitionBy("title", "text"))
    return p.select(F.col("id").alias("old_id"), first.alias("new_id")).where("old_id <> new_id")


def alias_merge_rewire(s: SparkSession, d: str) -> DataFrame:
    return store.rewire(edges(s, d), _aliases(s, d)).select("id", "from_node_id", "to_node_id", "edge_type")


def section_merge_pairs(s: SparkSession, d: str) -> DataFrame:
    """Titles that exactly one section with a link mark and one without bear: candidates for a merge."""
    x = seeded_nodes(s, d).where("node_type = 'guidance_section'").select("id", X.norm_words(F.col("title")).alias("t"), X.is_blank(F.col("url")).alias("bare"))
    g = x.groupBy("t").agg(F.count_if("bare").alias("without"), F.count_if(~F.col("bare")).alias("with"), F.min("id").alias("first_id"))
    return g.where("`without` + `with` > 1")


def url_normalise(s: SparkSession, d: str) -> DataFrame:
    return store.latest(table(s, d, "document_source"), "id").select("id", X.normalise_url(F.col("url")).alias("url"))


def source_classify_dedupe(s: SparkSession, d: str) -> DataFrame:
    """Each source's kind, dedupe key and canonical source; the file type is the URL's ending, a title its last name."""
    src = store.latest(table(s, d, "document_source"), "id").select("id", "url", "content_hash")
    path = F.regexp_replace(F.regexp_replace(F.lower(F.trim("url")), r"[?#].*$", ""), "/+$", "")
    ending = F.regexp_extract(path, r"\.([a-z0-9]{2,4})$", 1)
    kind = F.when(ending.isin("htm", "html") | (ending == "") | F.col("url").isNull(), "html").otherwise(ending)
    named = src.select(F.col("id").alias("source_id"), "url", F.col("content_hash").alias("checksum"), kind.alias("file_type"), F.regexp_extract(path, r"([^/]*)$", 1).alias("title"))
    return C.source_groups(named).select("source_id", "source_kind", "dedupe_key", "canonical_id", "decision")


def link_extract(s: SparkSession, d: str) -> DataFrame:
    return E.links(store.latest(table(s, d, "document_source"), "id"))


def id_hashes(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d)
    return n.select("id", hashed_id([F.col("node_type"), F.col("stable_key")]).alias("node_hash"), hashed_id([F.col("id"), F.col("url")], 20, ":").alias("edge_hash"), hashed_id([F.col("stable_key"), F.col("text")], 16, "|", "ge:", True).alias("instruction_hash"))


def roman_numerals(s: SparkSession, d: str) -> DataFrame:
    cited = E.legal_citations(nodes(s, d)).where("kind = 'annex'").select(F.regexp_extract("citation", "Annex ([IVXLC]+)", 1).alias("numeral")).distinct()
    return cited.select("numeral", X.roman_to_int(F.col("numeral")).alias("value"), X.column_number(F.col("numeral")).alias("as_column"))


def reference_resolution(s: SparkSession, d: str) -> DataFrame:
    """How resolved references end: by kind and method, with those that found a node and an edge that exists."""
    r = store.latest(table(s, d, "llm_reference_resolution"), "id")
    ok = F.trim(F.coalesce("target_node_id", F.lit(""))) != ""
    have = edges(s, d).select(F.col("from_node_id").alias("source_node_id"), F.col("to_node_id").alias("target_node_id")).distinct().withColumn("known", F.lit(1))
    j = r.join(have, ["source_node_id", "target_node_id"], "left")
    return j.groupBy("target_kind", "resolver_method").agg(F.count("*").alias("n"), F.count_if(ok).alias("resolved"), F.count_if(F.col("known").isNotNull()).alias("with_edge"), F.round(F.max(F.least(F.lit(0.92), F.col("extracted_confidence") * F.col("resolver_confidence"))), 6).alias("best"))


def heading_paths(s: SparkSession, d: str) -> DataFrame:
    """Carry-forward of headings over the spans of each source in their order."""
    sp = store.latest(table(s, d, "source_span"), "span_id").where("start_offset is not null")
    w = W.partitionBy("source_id").orderBy("start_offset", "span_id").rowsBetween(W.unboundedPreceding, 0)
    head = F.last(F.when(F.col("span_type") == "heading", F.col("raw_text")), ignorenulls=True).over(w)
    return sp.select("span_id", head.alias("heading"), F.size(F.split(F.coalesce("heading_path", F.lit("")), " > ")).alias("levels"))


QUERIES = {f.__name__: f for f in (schema_catalog, table_rows_search, list_nodes_page, unified_nodes_page, unified_edges_page, search_ilike, snippets, search_bm25, unified_search, canonical_documents, canonical_paragraphs, canonical_reason_counts, shared_term_edges, shared_obligation_edges, rollup_child_edges, regex_obligations, obligation_patterns, regex_rule_references, legal_citations, title_match_edges, quant_thresholds, quant_threshold_review, monetary_thresholds, evidence_backfill, alias_merge_rewire, section_merge_pairs, url_normalise, source_classify_dedupe, link_extract, id_hashes, roman_numerals, reference_resolution, heading_paths)}

_DS = "ds as (select * from document_source qualify row_number() over (partition by id order by loaded_at desc) = 1)"
_META = "case when json_valid(metadata_json) then metadata_json->>'$.{}' end"
_URL = """case when length(trim(url)) > 0 then lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) || regexp_replace(regexp_replace(b, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '/+$', '') || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(q, '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_|download=)'))), '&'), ''), '') end"""
_URLS = f"uu as (select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '\\?.*$', '') b, regexp_extract(regexp_replace(trim(url), '#.*$', ''), '\\?(.*)$', 1) q from ds), nu as (select *, {_URL} u from uu)"
_TOK = "list_filter(regexp_split_to_array(lower(concat_ws(' ', title, text)), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
_BM = f"""dc as (select id, title, {_TOK} t from n where length(trim(coalesce(title, '') || coalesce(text, ''))) > 0),
dl as (select id, title, len(t) d, len(list_filter(t, lambda x: x = 'ledger')) f0, len(list_filter(t, lambda x: x = 'stressed')) f1 from dc),
sx as (select count(*) n, avg(d) a, count(*) filter (f0 > 0) n0, count(*) filter (f1 > 0) n1 from dl),
bm as (select id, round(case when contains(lower(coalesce(title, '')), 'stressed ledger') then -1e6 else -(greatest(1e-6, ln((n - n0 + 0.5) / (n0 + 0.5))) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * d / a)) + greatest(1e-6, ln((n - n1 + 0.5) / (n1 + 0.5))) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * d / a))) end, 6) score from dl, sx where f0 > 0 and f1 > 0)"""
_CANON = f"""docs as (select id, title, url from n where node_type = 'guidance_document'),
ch as (select d.id, count(c.to_node_id) child_count, count(*) filter (p.id is not null and coalesce(p.pdf, false)) pdf_paragraphs, count(*) filter (p.id is not null and not coalesce(p.pdf, false)) html_paragraphs from docs d left join (select * from e where edge_type = 'contains') c on c.from_node_id = d.id left join (select id, {_META.format('source')} = 'pdf_text_extraction' pdf from n where node_type = 'guidance_paragraph') p on p.id = c.to_node_id group by d.id),
rk as (select d.id, row_number() over (partition by title order by (html_paragraphs > 0)::int desc, child_count desc, length(coalesce(url, '')), coalesce(url, ''), d.id) rank from docs d join ch on ch.id = d.id),
pa as (select to_node_id id, max((rank = 1)::int) has_canonical, max((rank > 1)::int) has_duplicate from e join rk on rk.id = from_node_id where edge_type = 'contains' group by to_node_id),
mt as (select id, node_type, {_META.format('document_title')} dt, coalesce({_META.format('source')} = 'pdf_text_extraction', false) pdf from n),
ht as (select distinct dt from mt where node_type = 'guidance_paragraph' and not pdf and dt is not null),
cn as (select mt.id, node_type, case when node_type = 'guidance_document' and coalesce(rank, 2) > 1 then 'duplicate_title' when node_type in ('guidance_paragraph', 'guidance_section') and coalesce(has_canonical, 1) = 0 and coalesce(has_duplicate, 0) = 1 then 'duplicate_document_child' when node_type in ('guidance_paragraph', 'guidance_section') and pdf and ht.dt is not null then 'pdf_suppressed' else 'canonical' end reason from mt left join rk on rk.id = mt.id left join pa on pa.id = mt.id left join ht on ht.dt = mt.dt)"""
_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_CLEAN = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_OBL = "\\b([A-Z][A-Za-z -]{2,80}?) (must|shall|should|may|is required to|are required to) (?:not )?([a-z]+) ([^.;:]{3,140})"
_OB = f"ob as (select id, unnest(range(1, len(s) + 1)) nth, s, m, a, o from (select id, regexp_extract_all(text, '{_OBL}', 1) s, regexp_extract_all(text, '{_OBL}', 2) m, regexp_extract_all(text, '{_OBL}', 3) a, regexp_extract_all(text, '{_OBL}', 4) o from n where length(text) > 40)), oo as (select id, nth, m[nth] modal, a[nth] action, array_to_string(list_filter(string_split({_NORM.format('o[nth]')}, ' '), lambda w: w not in ('a', 'an', 'the', 'any', 'each', 'every', 'its', 'of', 'to', 'and', 'or'))[1:8], ' ') object from ob)"
_SH = "us as (select distinct from_node_id a, to_node_id target from e where edge_type = '{t}' and from_node_id in (select id from n where node_type in ('rule', 'guidance_paragraph'))), ok as (select target from us group by 1 having count(*) between 2 and {m}), kp as (select * from us where target in (select target from ok))"
_CITE = "select distinct id, '{k}' kind, unnest(regexp_extract_all(text, '{p}', 0)) citation from n where length(text) > 0"
_CITES = " union all ".join(_CITE.format(k=k, p=p) for k, p in {"article": r"\bArt\. \d+(?:\(\d+\))?", "annex": r"\bAnnex [IVXLC]+(?:, para\. \d+)?", "chapter": r"\bchapter \d+", "section": r"\bsection \d+(?:\.\d+)+", "form": r"\bform [A-Z]\d+", "instrument": r"\bNo\. \d+ of \d{4}"}.items())
#: Snippets sn(id, snippet) of a table of texts, and their limits lm(id, snippet, kinds, found).
_SNIPPETS = "ps as (select id, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(coalesce(text, ''), '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x0b]+', ' ', 'g')), '([.!?])\\s+([{opens}])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') p from {src} where length(text) > 0), sn as (select distinct id, unnest(flatten(list_transform(p, lambda x: case when length(x) > case when len(p) = 1 then 600 else 900 end then list_transform(range(0, length(x), 350), lambda i: substring(x, i + 1, 450)) else [x] end))) snippet from ps)"
_LIMITS = "lv as (select id, snippet, " + ", ".join(f"list_transform(regexp_extract_all(plain, '{p}', 0), lambda x: trim(x)) {k}" for k, p in E.THRESHOLDS.items()) + " from (select *, regexp_replace(snippet, '[\\x{c0}-\\x{1fff}\\x{2c00}-\\x{2fff}\\x{3005}-\\x{ff00}\\x{ff10}-\\x{ffff}]', 'q', 'g') plain from sn)), lw as (select *, flatten([" + ", ".join(E.THRESHOLDS) + "]) av from lv), lm as (select id, snippet, array_to_string(list_filter([" + ", ".join(f"case when len({k}) > 0 then '{k}' end" for k in E.THRESHOLDS) + "], lambda x: x is not null), '; ') kinds, array_to_string(list_filter(list_transform(range(1, len(av) + 1), lambda i: case when list_position(av, av[i]) = i then av[i] end), lambda x: x is not null), '; ') found from lw)"
ORACLE = {
    "schema_catalog": " union all ".join(f"select '{t}' table_name, (select count(*) from information_schema.columns where table_name = '{t}') n_columns, count(*) n_rows from {t}" for t in TABLES),
    "table_rows_search": "select id, url from document_source where contains(lower(coalesce(id, '') || chr(1) || coalesce(source_type, '') || chr(1) || coalesce(url, '') || chr(1) || coalesce(fetched_at, '') || chr(1) || coalesce(content_hash, '') || chr(1) || coalesce(raw_html, '') || chr(1) || coalesce(raw_text, '')), 'audit')",
    "list_nodes_page": twin("select id, node_type, title from n where node_type in ('rule', 'guidance_paragraph') order by lower(title), id limit 50 offset 20"),
    "unified_nodes_page": twin("select * from (select 'rulebook' source, id, lower(title) as label from n union all select 'reporting', id, id from (select source_node_id id from g union select target_node_id from g)) order by label, source, id limit 100 offset 30"),
    "unified_edges_page": twin("with h as (select id from (select id, count(*) c from (select from_node_id id from e union all select to_node_id from e where to_node_id <> from_node_id or true) group by 1) where id in (select id from n) order by c desc, id limit 1) select id, from_node_id, to_node_id, edge_type from e where from_node_id = (select id from h) or to_node_id = (select id from h) order by edge_type, id limit 200"),
    "search_ilike": twin("select id, node_type from n where contains(lower(coalesce(title, '')), 'stressed ledger') or contains(lower(coalesce(text, '')), 'stressed ledger')"),
    "snippets": twin("select id, substring(text, greatest(strpos(lower(text), 'stressed') - 1 - 80, 0) + 1, 240) snippet from n where contains(lower(text), 'stressed ledger')"),
    "search_bm25": twin(f"with {_BM}, {_CANON} select id, score from bm where id in (select id from cn where reason = 'canonical') order by score, id limit 25"),
    "unified_search": twin(f"with {_BM} select * from (select 'rulebook' source, id, score from bm union all select 'reporting', edge_id, -1.0 from g where contains(lower(edge_type), 'template')) order by score, source, id limit 60"),
    "canonical_documents": "select id, row_number() over (partition by title order by (coalesce(html_paragraphs, 0) > 0)::int desc, coalesce(child_count, 0) desc, length(coalesce(url, '')), coalesce(url, ''), id) rank from canonical_guidance_document",
    "canonical_paragraphs": twin(f"with {_CANON} select id, (reason = 'canonical')::int is_canonical, reason from cn where node_type like 'guidance%'"),
    "canonical_reason_counts": twin(f"with {_CANON} select node_type, reason, count(*) n from cn group by 1, 2"),
    "shared_term_edges": twin(f"with {_SH.format(t='uses_defined_term', m=25)} select x.a, y.a b, x.target from kp x join kp y on x.target = y.target and x.a < y.a"),
    "shared_obligation_edges": twin(f"with {_SH.format(t='has_obligation_pattern', m=18)} select x.a, y.a b, x.target from kp x join kp y on x.target = y.target and x.a < y.a"),
    "rollup_child_edges": twin("with up as (select distinct from_node_id parent, to_node_id child from e where edge_type = 'contains'), ev as (select parent, to_node_id target, edge_type, child, round(max(least(0.78::double, greatest(0.35::double, coalesce(confidence, 0.5) * 0.72::double))), 6) confidence from up join e on e.from_node_id = up.child where edge_type in ('uses_defined_term', 'references', 'has_obligation_pattern') and parent <> to_node_id group by 1, 2, 3, 4) select parent, target, edge_type, child, confidence from (select *, row_number() over (partition by parent order by confidence desc, target, edge_type, child) k from ev) where k <= 450"),
    "regex_obligations": twin(f"with {_OB} select id, nth, modal, action, object from oo"),
    "obligation_patterns": twin(f"with {_OB} select modal || ':' || action || ':' || object pattern, count(distinct id) n_nodes, min(id) first_id from oo where length(object) >= 3 group by 1"),
    "regex_rule_references": seeded(f"""with b as (select id, node_type, {_CLEAN.format("lower(translate(coalesce(" + _META.format('part_title') + ", ''), '–—', '--'))")} part, coalesce({_META.format('rule_number')}, nullif(regexp_extract(title, '(\\d+\\.\\d+[A-Z]?)', 1), '')) number, coalesce(lower({_META.format('article_number')}), lower(nullif(regexp_extract(title, '(?i)^\\s*Article\\s+(\\d+[a-z]?)\\b', 1), ''))) article, text from n),
        ru as (select part, number, min(id) to_id from b where node_type = 'rule' and part <> '' and number is not null group by 1, 2),
        ar as (select part, article number, arg_min(id, {{'k': (node_type <> 'chapter')::int, 'i': id}}) to_id from b where node_type in ('chapter', 'rule') and part <> '' and article is not null group by 1, 2),
        tx as (select id, part, regexp_replace(text, '([^\\w/.])', '\\1\\1', 'g') tt, ' ' || regexp_replace(lower(translate(text, '–—', '--')), '\\s+', ' ', 'g') || ' ' low, text from b where node_type in ('rule', 'guidance_paragraph') and length(text) > 0),
        nu as (select id, part, unnest(regexp_extract_all(tt, '(?:^|[^\\w/])(\\d{{1,3}}\\.\\d{{1,3}}[A-Z]?)(?:\\(\\(?[a-z0-9ivx]+\\)\\)?)?(?:[^\\w/]|$)', 1)) number from tx),
        sa as (select distinct id from_id, to_id, 'same_part' as scope, nu.number reference, 0.82::double confidence from nu join ru on ru.part = nu.part and ru.number = nu.number where id <> to_id and nu.part <> ''),
        na as (select distinct id from_id, to_id, 'cross_part_named' as scope, ru.number reference, 0.88::double confidence from tx join ru on ru.part <> tx.part and id <> to_id and contains(low, ru.part || ' ' || lower(ru.number)) and regexp_matches(low, '[^a-z0-9]' || ru.part || ' ' || replace(lower(ru.number), '.', '\\.') || '(\\([a-z0-9ivx]+\\))?[^\\w/]')),
        al as (select id, part, unnest(regexp_extract_all(text, '(?i)\\b(?:Articles?|Arts?\\.)\\s+(\\d+[a-z]?(?:\\s*\\([a-z0-9]+\\))?(?:\\s*,\\s*(?:and\\s+)?\\d+[a-z]?(?:\\s*\\([a-z0-9]+\\))?)*(?:\\s*,?\\s*and\\s+\\d+[a-z]?(?:\\s*\\([a-z0-9]+\\))?)?)', 1)) refs from tx where not regexp_matches(text, '(?i)\\bCRR\\b')),
        am as (select id, part, unnest(regexp_extract_all(regexp_replace(refs, '\\([a-z0-9]+\\)', ' ', 'g'), '(?i)\\d+[a-z]?')) number from al),
        ra as (select distinct id from_id, to_id, 'same_part_article' as scope, lower(am.number) reference, 0.86::double confidence from am join ar on ar.part = am.part and ar.number = lower(am.number) where id <> to_id)
        select * from sa union all select * from na union all select * from ra"""),
    "legal_citations": twin(f"select * from ({_CITES})"),
    "title_match_edges": seeded(f"with p as (select {_CLEAN.format('lower(title)')} t, min(id) part_id from n where node_type = 'part' group by 1) select id, part_id from n join p on {_CLEAN.format('lower(title)')} = p.t where node_type <> 'part'"),
    "evidence_backfill": twin("select e.id, case when source_method in ('html_glossary_link', 'llm_reference', 'regex_rule_reference', 'regex_article_reference', 'inline_part_definition') then 'direct_text' when source_method in ('site_structure', 'html_anchor') then 'html_structure' when source_method = 'instrument_listing' then 'document_metadata' when source_method is not null then 'inferred' else 'missing' end status, case when trim(coalesce(evidence_text, '')) <> '' then evidence_text else coalesce(a.title, from_node_id) || ' ' || replace(edge_type, '_', ' ') || ' ' || coalesce(b.title, to_node_id) end evidence_text, coalesce(nullif(trim(source_url), ''), nullif(trim(a.url), ''), nullif(trim(b.url), '')) source_url from e left join n a on a.id = from_node_id left join n b on b.id = to_node_id"),
    "alias_merge_rewire": twin("with al as (select id old_id, min(id) over (partition by title, text) new_id from n where node_type = 'guidance_paragraph' and trim(text) <> ''), mv as (select e.id, coalesce(a.new_id, from_node_id) f, coalesce(b.new_id, to_node_id) t, edge_type, from_node_id = to_node_id was from e left join al a on a.old_id = from_node_id left join al b on b.old_id = to_node_id) select min(id) id, f from_node_id, t to_node_id, edge_type from mv where f <> t or was group by f, t, edge_type"),
    "section_merge_pairs": seeded(f"select {_NORM.format('title')} t, count(*) filter (coalesce(trim(url), '') = '') \"without\", count(*) filter (coalesce(trim(url), '') <> '') \"with\", min(id) first_id from n where node_type = 'guidance_section' group by 1 having count(*) > 1"),
    "url_normalise": f"with {_DS}, {_URLS} select id, u url from nu",
    "source_classify_dedupe": f"""with {_DS}, {_URLS}, pa as (select id, url, u, lower(trim(coalesce(content_hash, ''))) h, regexp_replace(regexp_replace(lower(trim(url)), '[?#].*$', ''), '/+$', '') p from nu),
        ft as (select *, case when url is null or regexp_extract(p, '\\.([a-z0-9]{{2,4}})$', 1) in ('', 'htm', 'html') then 'html' else regexp_extract(p, '\\.([a-z0-9]{{2,4}})$', 1) end f, coalesce(regexp_extract(p, '([^/]*)$', 1), '') title, lower(coalesce(regexp_extract(p, '([^/]*)$', 1), '') || ' ' || coalesce(url, '')) x from pa),
        kd as (select *, case when f = 'xml' then 'taxonomy_xml' when f = 'xsd' then 'taxonomy_schema' when f in ('xbrl', 'zip') or contains(x, 'taxonomy') or contains(x, 'xbrl') or contains(x, 'dpm') then 'taxonomy_package' when f in ('xlsx', 'xls', 'xlsm', 'csv') then 'template_workbook'
          when f = 'pdf' and regexp_matches(x, '\\b(instruction|instructions|guidance|guidelines|notes)\\b') then 'instruction_pdf' when f = 'pdf' and regexp_matches(x, '\\b(template|templates|workbook|data item)\\b') then 'template_pdf' when f = 'pdf' and regexp_matches(x, '\\b(cp|ps|ss|sop)\\d+/?\\d+\\b') then 'policy_pdf' when f = 'pdf' then 'pdf_document'
          when f = 'html' and contains(x, '/rules') then 'rulebook_html' when f = 'html' and contains(x, '/publication/') then 'policy_html' when f = 'html' then 'webpage_html' else 'other_source' end k from ft),
        ky as (select *, case when k like 'taxonomy%' and f <> 'zip' then 'source:' || id when coalesce(u, '') <> '' then 'url:' || u when h <> '' and f in ('pdf', 'html', 'xlsx', 'xls', 'xlsm', 'csv', 'doc', 'docx') and k not like 'taxonomy%' then 'checksum:' || f || ':' || k || ':' || h || ':' || regexp_replace(title, '[^a-z0-9]+', '', 'g') else 'source:' || id end dk from kd),
        ca as (select *, first_value(id) over (partition by dk order by contains(id, '-v-')::int, -length(title), id) c from ky)
        select id source_id, k source_kind, dk dedupe_key, c canonical_id, case when id <> c then 'duplicate_' || split_part(dk, ':', 1) else 'canonical' end decision from ca""",
    "link_extract": f"with {_DS}, l as (select id, regexp_extract_all(raw_html, '(?i)<a\\s[^>]*href=[\"'']([^\"'']*)[\"'']', 1) h from ds), x as (select id, unnest(range(0, len(h))) nth, h from l), y as (select id, nth, h[nth + 1] href from x) select id, nth, href, case when href like '#%' then 'anchor' when contains(href, '/rules') then 'rule' when regexp_matches(href, '(?i)^https?:') then 'external' else 'relative' end kind from y where not regexp_matches(href, '(?i)^(mailto|tel):')",
    "id_hashes": twin("select id, substr(sha1(coalesce(node_type, '') || '|' || coalesce(stable_key, '')), 1, 16) node_hash, substr(sha1(coalesce(id, '') || ':' || coalesce(url, '')), 1, 20) edge_hash, 'ge:' || substr(sha256(coalesce(stable_key, '') || '|' || coalesce(text, '')), 1, 16) instruction_hash from n"),
    "reference_resolution": twin("with r as (select * from llm_reference_resolution qualify row_number() over (partition by id order by loaded_at desc) = 1), h as (select distinct from_node_id, to_node_id from e) select target_kind, resolver_method, count(*) n, count(*) filter (trim(coalesce(target_node_id, '')) <> '') resolved, count(*) filter (h.from_node_id is not null) with_edge, round(max(least(0.92::double, extracted_confidence * resolver_confidence)), 6) best from r left join h on h.from_node_id = source_node_id and h.to_node_id = target_node_id group by 1, 2"),
    "heading_paths": "with sp as (select * from source_span qualify row_number() over (partition by span_id order by loaded_at desc) = 1) select span_id, last_value(case when span_type = 'heading' then raw_text end ignore nulls) over (partition by source_id order by start_offset, span_id rows between unbounded preceding and current row) heading, len(string_split(coalesce(heading_path, ''), ' > ')) levels from sp where start_offset is not null",
    "quant_thresholds": twin(f"with it as (select id, text from n union all select span_id, coalesce(normalised_text, raw_text) from source_span qualify row_number() over (partition by span_id order by loaded_at desc) = 1), {_SNIPPETS.format(src='it', opens='A-Z0-9£')}, {_LIMITS} select id, snippet, kinds, found from lm where kinds <> ''"),
    "quant_threshold_review": twin(f"with it as (select id, text from n), {_SNIPPETS.format(src='it', opens='A-Z0-9£')}, {_LIMITS} select n.node_type, min(snippet) snippet, array_to_string(list_sort(list_distinct(flatten(list(string_split(kinds, '; '))))), '; ') kinds, count(*) n, string_agg(distinct id, '; ' order by id) ids from lm join n using (id) where kinds <> '' group by n.node_type, lower(snippet)"),
    "monetary_thresholds": twin(f"with it as (select id, text from n where node_type in ('rule', 'guidance_paragraph', 'guidance_document')), {_SNIPPETS.format(src='it', opens='A-Z0-9£€')} select 'cand-' || substr(sha1(id || '|' || snippet), 1, 12) candidate, id, array_to_string(list_filter(list_transform(range(1, len(am) + 1), lambda i: case when list_position(am, am[i]) = i then am[i] end), lambda x: x is not null), '; ') amounts, case when (regexp_matches(snippet, '{E.NO_LIMIT}') and not regexp_matches(snippet, '{E.HARD_CUE}')) or regexp_matches(snippet, '{E.EXAMPLE}') then 'exclude' else 'review' end decision, regexp_matches(snippet, '{E.CUE}') cue from (select id, snippet, list_transform(regexp_extract_all(snippet, '{E.MONEY}', 0), lambda x: trim(x)) am from sn where regexp_matches(snippet, '{E.MONEY}'))"),
    "roman_numerals": twin("with c as (select distinct unnest(regexp_extract_all(text, '\\bAnnex ([IVXLC]+)', 1)) numeral from n where length(text) > 0), v as (select numeral, list_transform(string_split(numeral, ''), lambda x: (map{'I': 1, 'V': 5, 'X': 10, 'L': 50, 'C': 100})[x]) v from c) select numeral, list_sum([case when i < len(v) and v[i + 1] > v[i] then -v[i] else v[i] end for i in range(1, len(v) + 1)])::int as value, list_sum([(ascii(numeral[i]) - 64) * (26 ** (len(v) - i))::bigint for i in range(1, len(v) + 1)])::bigint as_column from v"),
}
