"""Repairs of references: anchors of cached pages, unresolved placeholders, typed and materialised references, robots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import hashed_id
from ..functions.text import clean_text
from .lookup import undated

#: Types of edges by the type of what a reference resolves to (fixed values).
EDGE_TYPES = {"DataItem": "REFERENCES_RETURN", "ReportingObligation": "REFERENCES_RETURN", "Template": "REFERENCES_TEMPLATE", "SourceDocument": "REFERENCES_SOURCE", "InstructionSet": "REFERENCES_SOURCE", "ValidationRule": "REFERENCES_SOURCE", "ExternalReference": "REFERENCES_EXTERNAL", "LegalInstrument": "REFERENCES_EXTERNAL", "PolicyStatement": "REFERENCES_EXTERNAL"}


def _path(url: Column) -> Column:
    """A URL's path without host, date, query, fragment and slashes at its ends."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    return F.regexp_replace(undated(bare), "^/+|/+$", "")


def page_anchors(pages: DataFrame, url: str = "url", html: str = "raw_html") -> DataFrame:
    """page, path, anchor, text: the links with an anchor of each cached page."""
    found = pages.select(F.col(url).alias("page"), F.explode(F.arrays_zip(F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*href=[\"']([^\"'#]*#[^\"']+)[\"'][^>]*>(.*?)</a>"), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*href=[\"']([^\"'#]*#[^\"']+)[\"'][^>]*>(.*?)</a>"), F.lit(2)).alias("t"))).alias("a"))
    text = clean_text(F.regexp_replace("a.t", "<[^>]*>", " "))
    return found.select("page", _path(F.col("a.href")).alias("path"), F.regexp_extract("a.href", "#(.+)$", 1).alias("anchor"), text.alias("text")).where("anchor <> ''")


def resolve_anchors(edges: DataFrame, nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """replaces_edge_id, from_node_id, to_node_id, anchor, basis, confidence: links of pages resolved to parsed nodes.

    A link's own anchor decides; where it has none, the anchor of the links on the same cached page with the same
    words and path, if they all name one. Of several nodes with one anchor the smallest id counts. A link never
    resolves to its own source or to where it leads already.
    """
    meta = lambda f: F.get_json_object("metadata_json", f"$.{f}")
    by_anchor = nodes.select("id", meta("html_id").alias("anchor")).where("anchor <> ''").groupBy("anchor").agg(F.min("id").alias("to_id"))
    links = edges.where("edge_type = 'references' and source_method = 'html_link'").select("id", "from_node_id", "to_node_id", "source_url", clean_text(F.col("evidence_text")).alias("text"), meta("href").alias("href")).where("href is not null")
    links = links.withColumn("own", F.regexp_extract("href", "#(.+)$", 1)).withColumn("path", _path(F.col("href")))
    said = page_anchors(pages).groupBy("page", "path", "text").agg(F.countDistinct("anchor").alias("n"), F.min("anchor").alias("found")).where("n = 1").drop("n")
    met = links.join(said, (links["own"] == "") & (links["source_url"] == said["page"]) & (links["path"] == said["path"]) & (links["text"] == said["text"]), "left").select("id", "from_node_id", "to_node_id", F.when(F.col("own") != "", F.col("own")).otherwise(F.col("found")).alias("anchor"), F.when(F.col("own") != "", "link_anchor").otherwise("source_html_href").alias("basis"))
    out = met.join(by_anchor, "anchor").where("to_id <> from_node_id and to_id <> to_node_id")
    return out.select(F.col("id").alias("replaces_edge_id"), "from_node_id", F.col("to_id").alias("to_node_id"), "anchor", "basis", F.lit(0.98).alias("confidence"))


def anchor_placeholders(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """replaces_edge_id, from_node_id, target_key, node_id, title, confidence: a placeholder of its own for each anchored
    link to a rule that was not resolved, so that links don't collapse onto a Part."""
    href = F.get_json_object("metadata_json", "$.href")
    whole = r"^https?://[^/]+/(pra-rules/[^#?]+)#([A-Za-z0-9]+)"
    left = edges.where("edge_type = 'references' and source_method = 'html_link'").join(resolved.select(F.col("replaces_edge_id").alias("id")), "id", "left_anti").where(href.rlike(whole))
    key = F.concat(F.lit("url:"), F.regexp_extract(href, whole, 1), F.lit("#"), F.regexp_extract(href, whole, 2))
    title = F.coalesce(F.nullif(F.trim("evidence_text"), F.lit("")), F.regexp_extract(href, whole, 2))
    return left.select(F.col("id").alias("replaces_edge_id"), "from_node_id", key.alias("target_key"), hashed_id([key]).alias("node_id"), title.alias("title"), F.lit(0.55).alias("confidence"))


def typed_edges(resolved: DataFrame, least: float = 0.8, least_extracted: float = 0.72) -> DataFrame:
    """source, target, edge_type, confidence: edges of resolved(source, target, target_type, score, extracted), typed by target."""
    kinds = F.create_map(*(F.lit(x) for kv in EDGE_TYPES.items() for x in kv))
    good = resolved.where((F.trim("target") != "") & (F.col("score") >= least) & (F.col("extracted") >= least_extracted))
    kind = F.coalesce(kinds[F.col("target_type")], F.lit("REFERENCES_RULE"))
    return good.groupBy("source", "target", kind.alias("edge_type")).agg(F.round(F.max(F.least(F.lit(0.93), F.col("score") * F.col("extracted"))), 6).alias("confidence"))


def materialised(refs: DataFrame, support: int = 2, examples: int = 5) -> DataFrame:
    """key, node_id, n, sources, examples: a node for each key that enough different sources name, with some examples.

    refs(key, source, text). Ranges and standards (their key says so) need one source only.
    """
    per = refs.where(F.trim("key") != "").groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))
    alone = F.col("key").rlike("^(range|ifrs|ecb|eba):")
    kept = per.where((F.col("sources") >= support) | alone)
    from pyspark.sql import Window as W

    first = refs.select("key", "text").distinct().withColumn("k", F.row_number().over(W.partitionBy("key").orderBy("text"))).where(F.col("k") <= examples)
    some = first.groupBy("key").agg(F.array_join(F.sort_array(F.collect_list("text")), " | ").alias("examples"))
    return kept.join(some, "key").select("key", hashed_id([F.col("key")], prefix="ref:").alias("node_id"), "n", "sources", "examples")


def allowed_by_robots(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, allowed: whether no disallowed pattern of rules(host, pattern) fits a URL's path; * stands for anything."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    quoted = F.regexp_replace(F.regexp_replace("pattern", r"([.?+^$()\[\]{}|\\])", r"\\$1"), r"\*", ".*")
    r = rules.where("pattern <> ''").select(F.lower("host").alias("h"), F.concat(F.lit("^"), quoted).alias("p"))
    u = urls.select("url").distinct().withColumn("h", host).withColumn("path", F.when(path == "", "/").otherwise(path))
    bad = u.join(r, "h").where(F.regexp_like("path", F.col("p"))).select("url").distinct().withColumn("bad", F.lit(True))
    return u.join(bad, "url", "left").select("url", F.col("bad").isNull().alias("allowed"))


def compact_lines(lines: DataFrame, fields: list[str], column: str = "value") -> DataFrame:
    """Records of compact JSON lines {"id": ..., "references": [[...], ...]}: id, nth and the fields by their place.

    An unreadable line gives one row with a null id and the line in _corrupt; shorter lists give nulls.
    """
    v = F.from_json(column, "id string, references array<array<string>>, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    p = lines.select(F.col(column).alias("_line"), v.alias("v")).select("_line", "v.id", "v.references")
    bad = F.col("id").isNull()
    rows = p.select("id", F.when(bad, F.col("_line")).alias("_corrupt"), F.posexplode_outer("references").alias("nth", "r"))
    return rows.where("r is not null or _corrupt is not null").select("id", "nth", *(F.get("r", F.lit(i)).alias(f) for i, f in enumerate(fields)), "_corrupt")
