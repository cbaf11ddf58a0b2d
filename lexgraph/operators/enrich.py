"""Edges and facts derived from texts and shared targets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import hashed_id
from ..functions.text import clean_text, is_blank

MODALS = r"must|shall|should|may|is required to|are required to"


def shared_target_edges(edges: DataFrame, users: DataFrame, edge_type: str, least: int, most: int) -> DataFrame:
    """a < b, target: pairs of users of one target that has between `least` and `most` users.

    The bound on users comes before the self-join, so no group yields more than most * (most - 1) / 2 pairs.
    """
    use = edges.where(F.col("edge_type") == edge_type).join(users.select(F.col("id").alias("from_node_id")), "from_node_id", "left_semi").select(F.col("from_node_id").alias("a"), F.col("to_node_id").alias("target")).distinct()
    fit = use.groupBy("target").agg(F.count("*").alias("c")).where(F.col("c").between(least, most)).select("target")
    kept = use.join(fit, "target")
    return kept.join(kept.withColumnRenamed("a", "b"), "target").where("a < b").select("a", "b", "target")


def child_edges_on_container(edges: DataFrame, types: tuple[str, ...], most: int = 450) -> DataFrame:
    """Edges of children repeated on their container, at most `most` of each container by confidence (a report limit)."""
    up = edges.where("edge_type = 'contains'").select(F.col("from_node_id").alias("parent"), F.col("to_node_id").alias("child")).distinct()
    own = edges.where(F.col("edge_type").isin(*types)).select("id", F.col("from_node_id").alias("child"), F.col("to_node_id").alias("target"), "edge_type", F.least(F.lit(0.78), F.greatest(F.lit(0.35), F.coalesce("confidence", F.lit(0.5)) * 0.72)).alias("confidence"))
    every = up.join(own, "child").where("parent <> target").groupBy("parent", "target", "edge_type", "child").agg(F.max("confidence").alias("confidence"))
    order = W.partitionBy("parent").orderBy(F.desc(F.round("confidence", 6)), "target", "edge_type", "child")
    return every.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")


def obligations(nodes: DataFrame, modals: str = MODALS, most: int | None = None) -> DataFrame:
    """id, nth, subject, modal, action, object: the obligations of each text longer than 40 characters.

    most: only the first so many of a text.
    """
    pattern = rf"\b([A-Z][A-Za-z -]{{2,80}}?) ({modals}) (?:not )?([a-z]+) ([^.;:]{{3,140}})"
    names = ("subject", "modal", "action", "object")
    base = nodes.where(F.length("text") > 40).select("id", *(F.regexp_extract_all("text", F.lit(pattern), F.lit(i + 1)).alias(x) for i, x in enumerate(names)))
    found = F.arrays_zip(*names)
    rows = base.select("id", F.posexplode(found if most is None else F.slice(found, 1, most)).alias("nth", "o"))
    return rows.select("id", (F.col("nth") + 1).alias("nth"), *(F.col(f"o.{x}").alias(x) for x in names))


def normalised_object(c):
    """Letters and digits only, function words dropped, the first eight words."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), " "), lambda w: ~w.isin("a", "an", "the", "any", "each", "every", "its", "of", "to", "and", "or"))
    return F.array_join(F.slice(words, 1, 8), " ")


#: References in texts (fixed values): rule numbers, lists of articles, and what shows that an article is the regulation's.
_RULE_NUMBER = r"(?<![\w/])(\d{1,3}\.\d{1,3}[A-Z]?)(?:\([a-z0-9ivx]+\))?(?![\w/])"
_ARTICLES = r"\b(?:Articles?|Arts?\.)\s+(\d+[a-z]?(?:\s*\([a-z0-9]+\))?(?:\s*,\s*(?:and\s+)?\d+[a-z]?(?:\s*\([a-z0-9]+\))?)*(?:\s*,?\s*and\s+\d+[a-z]?(?:\s*\([a-z0-9]+\))?)?)"
_OUTSIDE = r"\b(?:UK\s+)?CRR\b"
CONFIDENCE = {"same_part": 0.82, "same_part_article": 0.86, "uk_crr": 0.90, "cross_part_named": 0.88}


def text_references(nodes: DataFrame, pad: int = 90) -> DataFrame:
    """from_id, to_id, scope, reference, confidence, evidence: what rules and paragraphs name in their texts.

    Rules of the own Part by number, articles of the own Part, articles of the regulation outside (when its name stands
    within `pad` characters), and rules of a Part named right before the number. One edge for each source, target and
    reference, never to itself; the evidence is the first place with its surroundings. A rule's number and an article's
    are in the metadata, else in the title; of several nodes with one number the chapter, then the smallest id counts.
    """
    meta = lambda f: F.get_json_object("metadata_json", f"$.{f}")
    part = clean_text(F.lower(F.translate(F.coalesce(meta("part_title"), F.lit("")), "–—", "--")))
    known = nodes.select("id", "node_type", part.alias("part"), F.coalesce(meta("rule_number"), F.expr(r"nullif(regexp_extract(title, '(\\d+\\.\\d+[A-Z]?)', 1), '')")).alias("number"), F.coalesce(F.lower(meta("article_number")), F.lower(F.expr(r"nullif(regexp_extract(title, '(?i)^\\s*Article\\s+(\\d+[a-z]?)\\b', 1), '')"))).alias("article"))
    rules = known.where("node_type = 'rule' and part <> '' and number is not null").groupBy("part", "number").agg(F.min("id").alias("to_id"))
    first = F.min(F.struct(F.when(F.col("node_type") == "chapter", 0).otherwise(1).alias("k"), "id"))["id"]
    articles = known.where("node_type in ('chapter', 'rule') and part <> '' and article is not null").groupBy("part", F.col("article").alias("number")).agg(first.alias("to_id"))
    longest = rules.agg(F.max(F.size(F.split("part", " ")))).first()[0] or 0  # words of the longest title
    src = nodes.where("node_type in ('rule', 'guidance_paragraph') and length(text) > 0").select("id", part.alias("part"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, several, outside, one = re.compile(_RULE_NUMBER), re.compile(_ARTICLES, re.I), re.compile(_OUTSIDE, re.I), re.compile(r"(\d+[a-z]?)(?:\s*\([a-z0-9]+\))?", re.I)
        for b in batches:
            rows: dict[tuple, str] = {}
            for i, p, t in zip(*(c.to_pylist() for c in b.columns)):
                window = lambda m, t=t: " ".join(t[max(0, m.start() - pad) : m.end() + pad].split())
                for m in number.finditer(t):
                    rows.setdefault((i, "same_part", p, m[1]), window(m))
                    # The words before the number, from one to as many as a title has.
                    if t[m.start() - 1 : m.start()].isspace():
                        before = t[: m.start()][-40 * longest :].lower().replace("–", "-").replace("—", "-").split()
                        for k in range(1, min(longest, len(before)) + 1):
                            rows.setdefault((i, "cross_part_named", re.sub(r"^[^a-z0-9]+", "", " ".join(before[-k:])), m[1]), window(m))
                for m in several.finditer(t):
                    w = window(m)
                    for a in one.finditer(m[1]):
                        rows.setdefault((i, "uk_crr", "", a[1].lower()) if outside.search(w) else (i, "same_part_article", p, a[1].lower()), w)
            if rows:
                ids, scopes, parts, numbers = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (ids, scopes, parts, numbers, list(rows.values()))], ["from_id", "scope", "part", "number", "evidence"])

    said = src.mapInArrow(run, "from_id string, scope string, part string, number string, evidence string").where("part <> '' or scope = 'uk_crr'")
    inside = said.where("scope in ('same_part', 'cross_part_named')").join(rules, ["part", "number"])
    inside = inside.unionByName(said.where("scope = 'same_part_article'").join(articles, ["part", "number"]))
    own = src.select(F.col("id").alias("from_id"), F.col("part").alias("own"))
    # A rule of the own Part that is named by its Part too is one of the own Part.
    inside = inside.join(own, "from_id").where("from_id <> to_id and not (scope = 'cross_part_named' and part = own)").drop("own")
    out = said.where("scope = 'uk_crr'").withColumn("to_id", F.concat(F.lit("external:uk-crr:article:"), "number"))
    confidence = F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv))
    return inside.unionByName(out).select("from_id", "to_id", "scope", F.col("number").alias("reference"), confidence[F.col("scope")].alias("confidence"), "evidence").dropDuplicates(["from_id", "to_id", "scope", "reference"])


def legal_citations(nodes: DataFrame) -> DataFrame:
    """id, kind, citation: articles, annexes, chapters, sections, forms and instruments that texts cite, once each."""
    kinds = {"article": r"\bArt\. \d+(?:\(\d+\))?", "annex": r"\bAnnex [IVXLC]+(?:, para\. \d+)?", "chapter": r"\bchapter \d+", "section": r"\bsection \d+(?:\.\d+)+", "form": r"\bform [A-Z]\d+", "instrument": r"\bNo\. \d+ of \d{4}"}

    def labelled(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("citation"))

    parts = F.flatten(F.array(*(F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(0))), labelled(k)) for k, p in kinds.items())))
    return nodes.where(F.length("text") > 0).select("id", F.explode(parts).alias("c")).select("id", "c.kind", "c.citation")


#: Classes of quantitative limits (fixed values).
_AMOUNT = r"\d[\d,]*(?:\.\d+)?\s?(?:m|mn|million|bn|billion|k|thousand)?"
_NUMBER = r"\b\d[\d,]*(?:\.\d+)?\b"
_COMPARED = r"(?:at least|at most|more than|less than|greater than|fewer than|no more than|no less than|not less than|not more than|exceeds?|exceeding|below|above|under|over|not exceeding|minimum|max(?:imum)?|threshold|limit|floor|cap|within|by no later than|equal to or greater than|equal to or less than|≥|≤|>=|<=|>|<)"
THRESHOLDS = {
    "currency": rf"(?i)(?:£\s?{_AMOUNT}|\bGBP\s?{_AMOUNT}|\b\d[\d,]*(?:\.\d+)?\s?(?:pounds?|sterling)\b)",
    "percentage": r"(?i)\b\d+(?:\.\d+)?\s?(?:%|(?:per cent|percent|percentage points?)\b)",
    "basis_points": r"(?i)\b\d+(?:\.\d+)?\s?(?:basis points?|bps)\b",
    "ratio_multiple": r"(?i)\b\d+(?:\.\d+)?(?:\s?times|x)\b",
    "time_period": r"(?i)\b\d+(?:\.\d+)?\s?(?:business\s+)?(?:days?|weeks?|months?|years?|hours?)\b",
    "comparative_numeric": rf"(?i)(?:\b{_COMPARED}\b[^.;:()\n]{{0,90}}{_NUMBER}|{_NUMBER}[^.;:()\n]{{0,90}}\b{_COMPARED}\b)",
}
#: Money in a text, and the cues that speak for a limit or against one (fixed values).
MONEY = rf"(?i)(?:£\s?{_AMOUNT}|\b(?:GBP|EUR)\s?{_AMOUNT}|€\s?{_AMOUNT}|\b\d[\d,]*(?:\.\d+)?\s?(?:pounds?|sterling|euros?)\b)"
_BOUND = r"threshold|limit|minimum|maximum|floor|cap|exceed(?:s|ed|ing)?|greater than|more than|less than|below|above|under|over|not exceeding|no more than|no less than|at least|at most|equal to or greater than|equal to or less than|only .* with|applies? where|eligible|qualif(?:y|ies|ying)"
HARD_CUE = rf"(?i)\b(?:{_BOUND})\b|[<>≤≥]"
CUE = rf"(?i)\b(?:{_BOUND}|required|requirement|small company|size band|turnover|assets?|income|revenue|fees?)\b|[<>≤≥]"
NO_LIMIT = r"(?i)\b(?:for example|example|illustration|carrying value|fair value|balance sheet|account balance|reported amount|amount reported|book value|transactional account|profit or loss|dividend|paid|received|fine imposed|penalty imposed|costs? of|fee paid|invoice|remuneration paid)\b"
EXAMPLE = r"(?i)\b(?:for example|example|illustration)\b"
#: Texts without a sentence's end from this length on, and sentences from that one on, are read in windows.
UNDIVIDED, LONG_SENTENCE, WINDOW, STEP = 600, 900, 450, 350


def sentences(text: Column, opens: str = "A-Z0-9£") -> Column:
    """The sentences of a text with white space collapsed; undivided text and very long sentences as overlapping windows."""
    whole = clean_text(F.coalesce(text, F.lit("")))
    parts = F.filter(F.transform(F.split(whole, rf"(?<=[.!?])\s+(?=[{opens}])"), lambda x: F.trim(x)), lambda p: p != "")
    windows = lambda p: F.transform(F.sequence(F.lit(0), F.length(p) - 1, F.lit(STEP)), lambda i: F.substring(p, i + 1, F.lit(WINDOW)))
    most = F.when(F.size(parts) == 1, UNDIVIDED).otherwise(LONG_SENTENCE)
    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > most, windows(p)).otherwise(F.array(p))))


def thresholds(items: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """key, snippet, kinds, found: every sentence or window with a quantitative limit, once for each item.

    kinds are the classes in their order, found all different values in the order of the classes.
    """
    s = items.where(F.length(text) > 0).select(key, F.explode(F.array_distinct(sentences(F.col(text)))).alias("snippet"))
    values = {k: F.transform(F.regexp_extract_all("snippet", F.lit(p), F.lit(0)), lambda x: F.trim(x)) for k, p in THRESHOLDS.items()}
    kinds = F.filter(F.array(*(F.when(F.size(v) > 0, k) for k, v in values.items())), lambda x: x.isNotNull())
    found = s.select(key, "snippet", F.array_join(kinds, "; ").alias("kinds"), F.array_join(F.array_distinct(F.flatten(F.array(*values.values()))), "; ").alias("found"))
    return found.where("kinds <> ''")


def grouped_thresholds(found: DataFrame, group: list[str], key: str = "id") -> DataFrame:
    """Snippets alike but for case, of one group: group, snippet (the least), kinds, n, ids (in order)."""
    same = F.lower(F.col("snippet"))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("kinds", "; "))))), "; ")
    return found.groupBy(*group, same.alias("same")).agg(F.min("snippet").alias("snippet"), kinds.alias("kinds"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(key)), "; ").alias("ids")).drop("same")


def monetary_decision(c: Column) -> Column:
    """exclude or review: whether a sentence may hold a monetary limit."""
    t = clean_text(F.coalesce(c, F.lit("")))
    return F.when(~t.rlike(MONEY), "exclude").when(t.rlike(NO_LIMIT) & ~t.rlike(HARD_CUE), "exclude").when(t.rlike(EXAMPLE), "exclude").otherwise("review")


def monetary_candidates(items: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """candidate, key, sentence, amounts, decision, cue: sentences with money, with a stable id made of item and sentence."""
    s = items.where(F.length(text) > 0).select(key, F.explode(F.array_distinct(sentences(F.col(text), "A-Z0-9£€"))).alias("sentence")).where(F.col("sentence").rlike(MONEY))
    amounts = F.array_join(F.array_distinct(F.transform(F.regexp_extract_all("sentence", F.lit(MONEY), F.lit(0)), lambda x: F.trim(x))), "; ")
    name = hashed_id([F.col(key), F.col("sentence")], 12, "|", "cand-")
    return s.select(name.alias("candidate"), key, "sentence", amounts.alias("amounts"), monetary_decision(F.col("sentence")).alias("decision"), F.col("sentence").rlike(CUE).alias("cue"))


def backfill_evidence(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, status, evidence_text, source_url: evidence status by method, a default text and a URL from the ends."""
    status = (
        F.when(F.col("source_method").isin("html_glossary_link", "llm_reference", "regex_rule_reference", "regex_article_reference", "inline_part_definition"), "direct_text")
        .when(F.col("source_method").isin("site_structure", "html_anchor"), "html_structure")
        .when(F.col("source_method") == "instrument_listing", "document_metadata")
        .when(F.col("source_method").isNotNull(), "inferred")
        .otherwise("missing")
    )
    n = nodes.select("id", "title", F.expr("nullif(trim(url), '')").alias("url"))
    a, b = n.toDF("from_node_id", "from_title", "from_url"), n.toDF("to_node_id", "to_title", "to_url")
    j = edges.join(a, "from_node_id", "left").join(b, "to_node_id", "left")
    text = F.when(~is_blank(F.col("evidence_text")), F.col("evidence_text")).otherwise(F.concat(F.coalesce("from_title", "from_node_id"), F.lit(" "), F.translate("edge_type", "_", " "), F.lit(" "), F.coalesce("to_title", "to_node_id")))
    url = F.coalesce(F.expr("nullif(trim(source_url), '')"), "from_url", "to_url")
    return j.select("id", status.alias("status"), text.alias("evidence_text"), url.alias("source_url"))


def links(df: DataFrame, key: str = "id", html: str = "raw_html") -> DataFrame:
    """key, nth, href, kind: every link of a page with its class; mail and phone links are skipped."""
    found = df.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*href=[\"']([^\"']*)[\"']"), F.lit(1))).alias("nth", "href"))
    kind = F.when(F.col("href").rlike("(?i)^(mailto|tel):"), "skip").when(F.col("href").startswith("#"), "anchor").when(F.col("href").contains("/rules"), "rule").when(F.col("href").rlike("(?i)^https?:"), "external").otherwise("relative")
    return found.select(key, "nth", "href", kind.alias("kind")).where("kind <> 'skip'")
