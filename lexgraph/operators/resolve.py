"""Resolution of extracted references, URL propagation, clause-level obligations and segmentation of pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm_words
from ..runtime import cut

#: Scores of the candidate generators and the order of node types among equals (fixed values).
SCORES = {
    "exact_defined_term_title": 0.985, "uk_crr_external_article": 0.99, "exact_part_title": 0.90, "exact_guidance_document_title": 0.90, "exact_node_title": 0.945,
    "provision_identifier_with_context": 0.975, "provision_identifier_no_context": 0.74, "article_with_part_context": 0.9, "article_title_no_part_context": 0.72, "guidance_code_title": 0.91,
}
OTHER_KIND = 0.02
PRIORITY = {"rule": 5, "chapter": 4, "guidance_paragraph": 4, "guidance_section": 3, "defined_term": 3, "part": 2, "guidance_document": 2}
#: Kinds of reference (fixed values): those that name a provision, those that name a document, and those met by chapters.
PROVISIONS = ("rule", "chapter", "section", "article", "annex", "table", "template")
DOCUMENTS = ("part", "guidance", "legal instrument", "statute", "regulation", "directive", "policy statement", "consultation", "external", "unknown")
CHAPTER_LIKE = ("chapter", "section", "annex", "table", "template")
#: Names of the regulation that is kept outside, and of the Parts that restate it (fixed values).
BARE_CRR = ("crr", "the crr", "uk crr", "the uk crr")
LIQUIDITY = ("liquidity coverage ratio crr", "liquidity crr")
#: Patterns of references (fixed values).
ARTICLE = r"(?i)\bArticle\s+(\d+[A-Z]?)(?:\s*\(\s*([0-9A-Za-z]+)\s*\))?"
ARTICLE_ONLY = r"(?i)\bArticle\s+(\d+[A-Z]?)\b"
CRR = r"(?i)\b(?:of\s+the\s+|of\s+)?(?:UK\s+)?CRR\b"
IDENTIFIER = r"(?i)\b(\d+[A-Z]?(?:\d+)?(?:\.\d+[A-Z]?)*|\d+[A-Z]\d+(?:\.\d+[A-Z]?)?)\b"
CODE = r"(?i)\b((?:SS|SoP|CP|PS)\s*\d+\/\d{2})\b"


def _has(a: Column, b: Column) -> Column:
    return F.contains(a, b)


def _same_part(wanted: Column, part: Column) -> Column:
    """Whether one of two normalised names contains the other; a name that is missing fits nothing."""
    return (F.coalesce(part, F.lit("")) != "") & (_has(wanted, part) | _has(part, wanted))


def _first(c: Column) -> Column:
    """The non-empty text, else null."""
    return F.when(c != "", c)


def resolve(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """ref_id, target_id, method, score: the best node for each reference(ref_id, source_id, text, ident, doc, evidence, kind).

    Every generator is an equi-join on a key computed on both sides: the title of a defined term, of a Part or document,
    of a provision; the number of a provision within the Part named or the source's own; an article's number; a guidance
    code that a title starts with. An article of the regulation itself resolves to a node outside, whatever else fits.
    A reference never resolves to its own source. The highest score wins, then the node type, then the smallest id.
    Candidates are looked up once for each different question, and of those alike in all but the id two are kept, as
    only the source itself can be ruled out.
    """
    priority = F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))
    meta = lambda c, f: F.get_json_object(c, f"$.{f}")
    n = nodes.select(
        "id",
        "node_type",
        norm_words(F.coalesce("title", F.lit(""))).alias("t"),
        F.lower(F.trim(F.coalesce("title", F.lit("")))).alias("bare"),
        F.lower(F.rtrim(F.regexp_replace(F.split(F.coalesce("title", F.lit("")), " ")[0], r"\.+$", ""))).alias("head"),
        F.regexp_replace(F.coalesce(*(_first(meta("metadata_json", f)) for f in ("rule_number", "display_number", "section_number", "paragraph_number")), F.lit("")), r"\.+$", "").alias("number"),
        norm_words(F.coalesce(meta("metadata_json", "part_title"), F.lit(""))).alias("part"),
        norm_words(F.coalesce(meta("metadata_json", "document_title"), F.lit(""))).alias("document"),
    )
    text = lambda c: F.coalesce(c, F.lit(""))
    r = refs.select("ref_id", "source_id", *(text(F.col(c)).alias(c) for c in ("text", "ident", "doc", "evidence")), norm_words(text(F.col("kind"))).alias("kind"))
    context = n.select(F.col("id").alias("source_id"), F.col("part").alias("s_part"), F.col("document").alias("s_document"))
    r = r.join(context, "source_id", "left")
    whole = F.concat_ws(" ", "text", "ident", "evidence")
    named = F.coalesce(_first(F.col("ident")), F.col("text"))
    doc = norm_words(F.col("doc"))
    r = r.select(
        "ref_id",
        "source_id",
        "kind",
        norm_words(F.col("ident")).alias("k1"),
        norm_words(F.col("text")).alias("k2"),
        doc.alias("k3"),
        F.col("kind").isin(*PROVISIONS).alias("specific"),
        F.coalesce(_first(doc), _first(F.col("s_part")), _first(F.col("s_document")), F.lit("")).alias("title_part"),
        F.coalesce(_first(doc), _first(F.col("s_part")), F.lit("")).alias("wanted"),
        F.regexp_extract(whole, ARTICLE, 1).alias("article"),
        F.regexp_extract(whole, ARTICLE, 2).alias("paragraph"),
        (doc.isin(*BARE_CRR) | whole.rlike(CRR)).alias("crr"),
        doc.isin(*LIQUIDITY).alias("liquidity"),
        F.regexp_replace(F.regexp_extract(named, IDENTIFIER, 1), r"\.+$", "").alias("num"),
        F.lower(F.regexp_extract(named, ARTICLE_ONLY, 1)).alias("art"),
        norm_words(F.regexp_extract(named, CODE, 1)).alias("code"),
    )
    outside = (F.col("article") != "") & F.col("crr") & ~F.col("liquidity")
    ext = F.concat(F.lit("external:uk-crr:article:"), F.lower("article"), F.when(F.col("paragraph") != "", F.concat(F.lit(":"), F.lower("paragraph"))).otherwise(""))
    external = r.where(outside).select("ref_id", ext.alias("target_id"), F.lit("uk_crr_external_article").alias("method"), F.lit(SCORES["uk_crr_external_article"]).alias("score"))
    r = cut(r.where(~outside))

    def looked_up(left: DataFrame, right: DataFrame, on: list[str], fits: Column | None, method: Column, score: Column) -> DataFrame:
        """Candidates of references: left(ref_id, source_id, on..., ask...) against right(id, node_type, on..., of...)."""
        ask = [c for c in left.columns if c not in ("ref_id", "source_id")]
        same = [c for c in right.columns if c != "id"]
        two = right.withColumn("nth", F.row_number().over(W.partitionBy(*same).orderBy("id"))).where("nth <= 2").groupBy(*same).agg(F.sort_array(F.collect_list("id")).alias("ids"))
        met = left.select(*ask).distinct().join(two, on)
        if fits is not None:
            met = met.where(fits)
        best = met.withColumn("method", method).withColumn("score", score).where("score is not null").select(*ask, "method", "score", "node_type", F.explode("ids").alias("target_id"))
        rank = W.partitionBy(*ask, "method").orderBy(F.desc("score"), F.desc(F.coalesce(priority[F.col("node_type")], F.lit(0))), "target_id")
        best = best.withColumn("nth", F.row_number().over(rank)).where("nth <= 2").drop("nth")
        return left.join(best, ask).where(F.col("source_id").isNull() | (F.col("target_id") != F.col("source_id"))).select("ref_id", "target_id", "node_type", "method", "score")

    by_key = r.select("*", F.explode(F.array_distinct(F.array("k1", "k2"))).alias("t")).where("t <> ''")
    wide = r.select("*", F.explode(F.array_distinct(F.when(F.col("specific"), F.array("k1", "k2")).otherwise(F.array("k1", "k2", "k3")))).alias("t")).where("t <> ''")
    titles = n.where("t <> ''")
    found = looked_up(by_key.select("ref_id", "source_id", "t"), titles.where("node_type = 'defined_term'").select("id", "node_type", "t"), ["t"], None, F.lit("exact_defined_term_title"), F.lit(SCORES["exact_defined_term_title"]))
    level = wide.where(F.col("kind").isin(*DOCUMENTS) | ~F.col("specific")).select("ref_id", "source_id", "t")
    doc_method = F.when(F.col("node_type") == "part", "exact_part_title").otherwise("exact_guidance_document_title")
    found = found.unionByName(looked_up(level, titles.where("node_type in ('part', 'guidance_document')").select("id", "node_type", "t"), ["t"], None, doc_method, F.lit(SCORES["exact_part_title"])))
    kind_of = F.when(F.col("kind").isin(*CHAPTER_LIKE), "chapter").when(F.col("kind") == "rule", "rule").when(F.col("specific"), "specific").otherwise("other")
    exact = wide.where("kind <> 'definition'").select("ref_id", "source_id", "t", kind_of.alias("asked"), F.when(F.col("specific"), F.col("title_part")).otherwise("").alias("in_part"))
    provisions = n.where("node_type in ('chapter', 'rule', 'guidance_section', 'guidance_paragraph')")
    of_part = (F.col("in_part") == "") | _same_part(F.col("in_part"), F.col("part")) | _same_part(F.col("in_part"), F.col("document"))
    not_bare = ~((F.col("asked") == "chapter") & (F.col("node_type") == "rule") & F.col("is_bare"))
    found = found.unionByName(looked_up(exact, provisions.select("id", "node_type", "t", "part", "document", (F.col("bare") == F.col("t")).alias("is_bare")), ["t"], of_part & not_bare, F.lit("exact_node_title"), F.lit(SCORES["exact_node_title"])))
    numbers = r.where("num <> '' and kind <> 'article' and article = ''").select("ref_id", "source_id", kind_of.alias("asked"), F.col("wanted").alias("in_part"), F.explode(F.array(F.concat(F.lit("n "), "num"), F.concat(F.lit("t "), F.lower("num")))).alias("key"))
    numbered = provisions.select("id", "node_type", "part", "document", F.explode(F.array(F.concat(F.lit("n "), F.col("number")), F.concat(F.lit("t "), F.col("head")))).alias("key")).where("length(key) > 2")
    base = F.when(F.col("in_part") != "", SCORES["provision_identifier_with_context"]).otherwise(SCORES["provision_identifier_no_context"])
    score = F.when((F.col("asked") == "rule") & (F.col("node_type") == "rule"), base).when((F.col("asked") == "chapter") & (F.col("node_type") == "chapter"), base).when(F.col("asked") == "other", F.round(base - OTHER_KIND, 6))
    method = F.when(F.col("in_part") != "", "provision_identifier_with_context").otherwise("provision_identifier_no_context")
    found = found.unionByName(looked_up(numbers, numbered, ["key"], of_part, method, score))
    articles = r.where("art <> ''").select("ref_id", "source_id", "art", F.regexp_extract("art", r"^\d+", 0).alias("digits"), F.col("wanted").alias("in_part"))
    chapters = n.where("node_type = 'chapter'").select("id", "node_type", "part", F.regexp_extract("t", r"^article (\w+)", 1).alias("named")).withColumn("digits", F.regexp_extract("named", r"^\d+", 0)).where("digits <> ''")
    rest = F.substr(F.col("named"), F.length("art") + 1)
    fits = F.startswith(F.col("named"), F.col("art")) & ~rest.rlike(r"^\d") & ((F.col("in_part") == "") | _has(F.col("in_part"), F.col("part")) | _has(F.col("part"), F.col("in_part")))
    method = F.when(F.col("in_part") != "", "article_with_part_context").otherwise("article_title_no_part_context")
    score = F.when(F.col("in_part") != "", SCORES["article_with_part_context"]).otherwise(SCORES["article_title_no_part_context"])
    found = found.unionByName(looked_up(articles, chapters, ["digits"], fits, method, score))
    coded = n.where("node_type = 'guidance_document'").select("id", "node_type", F.regexp_extract("t", r"^((?:ss|sop|cp|ps) ?\d+ \d\d)", 1).alias("code")).where("code <> ''")
    found = found.unionByName(looked_up(r.where("code <> ''").select("ref_id", "source_id", "code"), coded, ["code"], None, F.lit("guidance_code_title"), F.lit(SCORES["guidance_code_title"])))
    w = W.partitionBy("ref_id").orderBy(F.desc("score"), F.desc(F.coalesce(priority[F.col("node_type")], F.lit(0))), "target_id", "method")
    inside = cut(found).withColumn("k", F.row_number().over(w)).where("k = 1").select("ref_id", "target_id", "method", "score")
    return inside.unionByName(external)


def stage(resolved: DataFrame, refs: DataFrame, edges: DataFrame, least: float = 0.88, least_extracted: float = 0.7) -> DataFrame:
    """from_node_id, to_node_id, confidence, n_refs, methods, evidence: new edges where none of any type exists.

    A reference counts from a resolver score and an extracted confidence on; the edge's confidence is the highest
    min(0.92, score * extracted), its evidence the different quotes (else texts) of its references in their order.
    """
    j = resolved.join(refs.select("ref_id", "source_id", "extracted", "ref_index", F.coalesce(_first(F.trim("evidence")), F.col("text"), F.lit("")).alias("quote")), "ref_id").where("source_id is not null")
    have = edges.select(F.col("from_node_id").alias("source_id"), F.col("to_node_id").alias("target_id")).distinct()
    new = j.where((F.col("score") >= least) & (F.col("extracted") >= least_extracted)).join(have, ["source_id", "target_id"], "left_anti")
    quotes = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("ref_index", "ref_id", "quote"))), lambda x: x["quote"]))
    return new.groupBy(F.col("source_id").alias("from_node_id"), F.col("target_id").alias("to_node_id")).agg(
        F.round(F.max(F.least(F.lit(0.92), F.col("score") * F.col("extracted"))), 6).alias("confidence"),
        F.count("*").alias("n_refs"),
        F.array_join(F.sort_array(F.collect_set("method")), ",").alias("methods"),
        F.array_join(F.filter(quotes, lambda x: x != ""), "\n---\n").alias("evidence"),
    )


def propagate_urls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, url, origin: a node's own http URL, else that of its first edge with one, else that of a neighbour over its first edge."""
    http = lambda c: F.when(F.lower(c).rlike("^https?://"), c)
    own = nodes.select("id", http(F.trim("url")).alias("own"))
    ends = edges.select(F.col("from_node_id").alias("id"), F.col("to_node_id").alias("other"), F.col("id").alias("eid"), http(F.trim("source_url")).alias("eurl"))
    ends = ends.unionByName(edges.select(F.col("to_node_id").alias("id"), F.col("from_node_id").alias("other"), F.col("id").alias("eid"), http(F.trim("source_url")).alias("eurl")))
    bare = own.where("own is null").select("id")
    wanted = ends.join(bare, "id", "left_semi").join(own.toDF("other", "nurl"), "other", "left")
    best = wanted.groupBy("id").agg(F.min(F.when(F.col("eurl").isNotNull(), F.struct("eid", "eurl")))["eurl"].alias("eurl"), F.min(F.when(F.col("nurl").isNotNull(), F.struct("eid", "other", "nurl")))["nurl"].alias("nurl"))
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("eurl").isNotNull(), "edge").when(F.col("nurl").isNotNull(), "neighbour").otherwise("none")
    return own.join(best, "id", "left").select("id", F.coalesce("own", "eurl", "nurl").alias("url"), origin.alias("origin"))


def clause_obligations(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """id, sentence_no, modal, condition: sentences with a modal, and their first condition clause.

    most: only among the first so many sentences of a text.
    """
    parts = F.split("text", r"[.;] (?=[A-Z(])")
    s = nodes.where(F.length("text") > 40).select("id", F.posexplode(parts if most is None else F.slice(parts, 1, most)).alias("sentence_no", "sentence"))
    modal = F.regexp_extract("sentence", r"\b(must|shall|should|may|is required to|are required to)\b", 1)
    cond = F.regexp_extract("sentence", r"(?i)\b(if|where|when|unless|except where|provided that|subject to)\b", 1)
    return s.select("id", "sentence_no", modal.alias("modal"), F.lower(cond).alias("condition")).where("modal <> ''")


_NUMBER = re.compile(r"(?:\d{1,3}(?:\.\d{1,3})*|\([a-z]\))\s+\S")


def segment_lines(lines: list[str], most: int = 1800, short: int = 180) -> list[tuple[str, str]]:
    """(kind, text): numbered paragraphs, headings and other paragraphs of a document's lines.

    A numbered line or heading starts a segment; segments are flushed beyond `most` characters; a short unnumbered
    one joins the one before.
    """
    out: list[tuple[str, str]] = []
    kind, parts = "paragraph", []

    def flush() -> None:
        nonlocal parts
        body = " ".join(parts)
        if body:
            if kind == "paragraph" and len(body) < short and out and out[-1][0] != "heading" and len(out[-1][1]) + len(body) < most:
                out[-1] = (out[-1][0], f"{out[-1][1]} {body}")
            else:
                out.append((kind, body))
        parts = []

    for line in (x.strip() for x in lines):
        if not line or re.fullmatch(r"(?:page )?\d{1,4}(?: of \d+)?", line, re.I):
            continue
        numbered = _NUMBER.match(line) is not None
        heading = not numbered and len(line) <= 80 and line[0].isupper() and line[-1] not in ".,;:" and (line.isupper() or line.istitle())
        if numbered or heading or sum(map(len, parts)) + len(line) > most:
            flush()
            kind = "numbered" if numbered else "heading" if heading else "paragraph"
        elif kind == "heading":
            flush()
            kind = "paragraph"
        parts.append(line)
    flush()
    return out


def segment_sources(spans: DataFrame, kinds: tuple[str, ...] = ("page",)) -> DataFrame:
    """source_id, segment_no, kind, text over the pages of each source in their order.

    A source's pages are streamed in order within its partition; only the lines of the source at hand are held.
    """
    src = spans.where(F.col("span_type").isin(*kinds) & (F.length("raw_text") > 0) & F.col("source_id").isNotNull()).select("source_id", "page_number", "start_offset", "span_id", "raw_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(source: str, lines: list[str]) -> pa.RecordBatch:
            got = segment_lines(lines)
            return pa.RecordBatch.from_arrays([pa.array([source] * len(got), pa.string()), pa.array(range(1, len(got) + 1), pa.int32()), pa.array([k for k, _ in got], pa.string()), pa.array([t for _, t in got], pa.string())], ["source_id", "segment_no", "kind", "text"])

        now, lines = None, []
        for b in batches:
            for s, t in zip(b.column(0).to_pylist(), b.column(4).to_pylist()):
                if s != now and lines:
                    yield result(now, lines)
                    lines = []
                now = s
                lines += t.split("\n")
        if lines:
            yield result(now, lines)

    ordered = src.repartition("source_id").sortWithinPartitions("source_id", F.col("page_number").asc_nulls_last(), F.col("start_offset").asc_nulls_last(), "span_id")
    return ordered.mapInArrow(run, "source_id string, segment_no int, kind string, text string")
