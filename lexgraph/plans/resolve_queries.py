"""Queries of reference resolution, URL propagation, clause obligations and page segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolve as R
from ..operators import store
from ..runtime import table
from .graph import edges, nodes, twin


def _refs(s: SparkSession, d: str) -> DataFrame:
    r = store.latest(table(s, d, "llm_reference_resolution"), "id")
    return r.select(F.col("id").alias("ref_id"), F.col("source_node_id").alias("source_id"), "ref_index", F.col("reference_text").alias("text"), F.col("target_title_or_identifier").alias("ident"), F.col("target_part_or_document").alias("doc"), F.col("evidence_quote").alias("evidence"), F.col("target_kind").alias("kind"), F.col("extracted_confidence").alias("extracted"))


def resolve_references(s: SparkSession, d: str) -> DataFrame:
    return R.resolve(_refs(s, d), nodes(s, d))


def staged_reference_edges(s: SparkSession, d: str) -> DataFrame:
    return R.stage(R.resolve(_refs(s, d), nodes(s, d)), _refs(s, d), edges(s, d))


def url_propagation(s: SparkSession, d: str) -> DataFrame:
    return R.propagate_urls(nodes(s, d), edges(s, d))


def _by_clause(o: DataFrame) -> DataFrame:
    return o.groupBy("modal", "condition").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_nodes"))


def clause_obligations(s: SparkSession, d: str) -> DataFrame:
    return _by_clause(R.clause_obligations(nodes(s, d)))


def source_segments(s: SparkSession, d: str) -> DataFrame:
    return R.segment_sources(store.latest(table(s, d, "source_span"), "span_id"))


QUERIES = {f.__name__: f for f in (resolve_references, staged_reference_edges, url_propagation, clause_obligations, source_segments)}
def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def _meta(f: str) -> str:
    return f"nullif(case when json_valid(metadata_json) then metadata_json->>'$.{f}' end, '')"


def _within(wanted: str) -> str:
    return f"({wanted} = '' or (k.part <> '' and (contains({wanted}, k.part) or contains(k.part, {wanted}))) or (k.document <> '' and (contains({wanted}, k.document) or contains(k.document, {wanted}))))"


_KINDS = "('chapter', 'section', 'annex', 'table', 'template')"
#: Every reference against every node, generator by generator.
_BEST = f"""rf as (select id ref_id, source_node_id source_id, ref_index, coalesce(reference_text, '') tx, coalesce(target_title_or_identifier, '') ident, coalesce(target_part_or_document, '') doc, coalesce(evidence_quote, '') ev, {_norm("coalesce(target_kind, '')")} kind, extracted_confidence extracted from llm_reference_resolution qualify row_number() over (partition by id order by loaded_at desc) = 1),
k as (select id, node_type, {_norm("coalesce(title, '')")} t, lower(trim(coalesce(title, ''))) bare, lower(regexp_replace(split_part(coalesce(title, ''), ' ', 1), '\\.+$', '')) head, regexp_replace(coalesce({_meta('rule_number')}, {_meta('display_number')}, {_meta('section_number')}, {_meta('paragraph_number')}, ''), '\\.+$', '') num, {_norm(f"coalesce({_meta('part_title')}, '')")} part, {_norm(f"coalesce({_meta('document_title')}, '')")} document,
  case node_type when 'rule' then 5 when 'chapter' then 4 when 'guidance_paragraph' then 4 when 'guidance_section' then 3 when 'defined_term' then 3 when 'part' then 2 when 'guidance_document' then 2 else 0 end prio from n),
r0 as (select rf.*, {_norm('ident')} k1, {_norm('tx')} k2, {_norm('doc')} k3, kind in ('rule', 'article', 'chapter', 'section', 'annex', 'table', 'template') spec, tx || ' ' || ident || ' ' || ev whole, case when ident <> '' then ident else tx end named, coalesce(c.part, '') sp, coalesce(c.document, '') sd from rf left join k c on c.id = rf.source_id),
r1 as (select *, coalesce(nullif(k3, ''), nullif(sp, ''), sd) title_part, coalesce(nullif(k3, ''), sp) wanted, regexp_extract(whole, '(?i)\\bArticle\\s+(\\d+[A-Z]?)', 1) article, regexp_extract(whole, '(?i)\\bArticle\\s+(\\d+[A-Z]?)(?:\\s*\\(\\s*([0-9A-Za-z]+)\\s*\\))?', 2) para,
  regexp_replace(regexp_extract(named, '(?i)\\b(\\d+[A-Z]?(?:\\d+)?(?:\\.\\d+[A-Z]?)*)\\b', 1), '\\.+$', '') num, lower(regexp_extract(named, '(?i)\\bArticle\\s+(\\d+[A-Z]?)\\b', 1)) art, {_norm("regexp_extract(named, '(?i)' || chr(92) || 'b((?:SS|SoP|CP|PS)' || chr(92) || 's*' || chr(92) || 'd+/' || chr(92) || 'd{2})' || chr(92) || 'b', 1)")} code from r0),
r as (select *, article <> '' and (k3 in ('crr', 'the crr', 'uk crr', 'the uk crr') or regexp_matches(whole, '(?i)\\bCRR\\b')) and k3 not in ('liquidity coverage ratio crr', 'liquidity crr') outside from r1),
c as (select ref_id, source_id, k.id, prio, 'exact_defined_term_title' as method, 0.985::double score from r join k on k.t in (k1, k2) and k.t <> '' and node_type = 'defined_term' where not outside
 union all select ref_id, source_id, k.id, prio, case node_type when 'part' then 'exact_part_title' else 'exact_guidance_document_title' end, 0.9 from r join k on k.t <> '' and (k.t in (k1, k2) or (not spec and k.t = k3)) and node_type in ('part', 'guidance_document') where not outside and not spec
 union all select ref_id, source_id, k.id, prio, 'exact_node_title', 0.945 from r join k on k.t <> '' and (k.t in (k1, k2) or (not spec and k.t = k3)) and node_type in ('chapter', 'rule', 'guidance_section', 'guidance_paragraph') where not outside and kind <> 'definition' and (not spec or {_within('title_part')}) and not (kind in {_KINDS} and node_type = 'rule' and bare = k.t)
 union all select ref_id, source_id, k.id, prio, case when wanted <> '' then 'provision_identifier_with_context' else 'provision_identifier_no_context' end, round(case when wanted <> '' then 0.975 else 0.74 end - case when spec then 0 else 0.02 end, 6)::double from r join k on (k.num = r.num or k.head = lower(r.num)) and node_type in ('chapter', 'rule', 'guidance_section', 'guidance_paragraph') where not outside and r.num <> '' and kind <> 'article' and article = '' and {_within('wanted')} and ((kind = 'rule' and node_type = 'rule') or (kind in {_KINDS} and node_type = 'chapter') or not spec)
 union all select ref_id, source_id, k.id, prio, case when wanted <> '' then 'article_with_part_context' else 'article_title_no_part_context' end, case when wanted <> '' then 0.9 else 0.72 end from r join k on art <> '' and node_type = 'chapter' and regexp_matches(k.t, '^article ' || art || '(?:\\b|[^0-9])') where not outside and (wanted = '' or contains(wanted, k.part) or contains(k.part, wanted))
 union all select ref_id, source_id, k.id, prio, 'guidance_code_title', 0.91 from r join k on code <> '' and node_type = 'guidance_document' and starts_with(k.t, code) where not outside),
best as (select ref_id, id target_id, method, score from c where id <> source_id or source_id is null qualify row_number() over (partition by ref_id order by score desc, prio desc, id, method) = 1
 union all select ref_id, 'external:uk-crr:article:' || lower(article) || case when para <> '' then ':' || lower(para) else '' end, 'uk_crr_external_article', 0.99 from r where outside)"""
_HTTP = "case when regexp_matches(lower(trim({0})), '^https?://') then trim({0}) end"
ORACLE = {
    "resolve_references": twin(f"with {_BEST} select ref_id, target_id, method, score from best"),
    "staged_reference_edges": twin(f"with {_BEST}, st as (select source_id, target_id, least(0.92::double, score * extracted) conf, method, coalesce(nullif(trim(ev), ''), tx) quote, ref_index, ref_id from best join rf using (ref_id) where source_id is not null and score >= 0.88 and extracted >= 0.7 and not exists (select 1 from e where from_node_id = source_id and to_node_id = target_id)), fq as (select source_id, target_id, quote, min(row(ref_index, ref_id)) pos from st where quote <> '' group by all), q as (select source_id, target_id, string_agg(quote, chr(10) || '---' || chr(10) order by pos) evidence from fq group by all) select st.source_id from_node_id, st.target_id to_node_id, round(max(conf), 6) confidence, count(*) n_refs, string_agg(distinct method, ',' order by method) methods, coalesce(max(evidence), '') evidence from st left join q on q.source_id = st.source_id and q.target_id = st.target_id group by 1, 2"),
    "url_propagation": twin(f"with own as (select id, {_HTTP.format('url')} own from n), ends as (select from_node_id id, to_node_id other, id eid, {_HTTP.format('source_url')} eurl from e union all select to_node_id, from_node_id, id, {_HTTP.format('source_url')} from e), w as (select ends.*, o.own nurl from ends left join own o on o.id = other), b as (select id, arg_min(eurl, eid) filter (eurl is not null) eurl, arg_min(nurl, {{'a': eid, 'b': other}}) filter (nurl is not null) nurl from w group by id) select own.id, coalesce(own, eurl, nurl) url, case when own is not null then 'own' when eurl is not null then 'edge' when nurl is not null then 'neighbour' else 'none' end origin from own left join b on b.id = own.id"),
    "clause_obligations": twin("with sp as (select id, unnest(string_split(regexp_replace(text, '[.;] ([A-Z(])', chr(1) || '\\1', 'g'), chr(1))) sentence from n where length(text) > 40), x as (select id, regexp_extract(sentence, '\\b(must|shall|should|may|is required to|are required to)\\b', 1) modal, lower(regexp_extract(sentence, '(?i)\\b(if|where|when|unless|except where|provided that|subject to)\\b', 1)) condition from sp) select modal, condition, count(*) n, count(distinct id) n_nodes from x where modal <> '' group by 1, 2"),
}
