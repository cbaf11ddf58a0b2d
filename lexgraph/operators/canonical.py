"""Canonical choice among documents of one title, and which of their children count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ladder, normalise_url


def document_rank(docs: DataFrame) -> DataFrame:
    """id, rank within the title: with web paragraphs first, then more children, shorter url, url, id."""
    url = F.coalesce("url", F.lit(""))
    order = [F.desc((F.coalesce("html_paragraphs", F.lit(0)) > 0).cast("int")), F.desc(F.coalesce("child_count", F.lit(0))), F.length(url), url, F.col("id")]
    return docs.select("id", "title", F.row_number().over(W.partitionBy("title").orderBy(*order)).alias("rank"))


def document_children(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per guidance document: child_count (missing children too), pdf_paragraphs and html_paragraphs."""
    docs = nodes.where("node_type = 'guidance_document'").select("id", "title", "url")
    parts = edges.where("edge_type = 'contains'").select(F.col("from_node_id").alias("id"), F.col("to_node_id").alias("child"))
    paras = nodes.where("node_type = 'guidance_paragraph'").select(F.col("id").alias("child"), F.coalesce(F.get_json_object("metadata_json", "$.source") == "pdf_text_extraction", F.lit(False)).alias("pdf"))
    counts = parts.join(paras, "child", "left").groupBy("id").agg(F.count("*").alias("child_count"), F.count_if("pdf").alias("pdf_paragraphs"), F.count_if(~F.col("pdf")).alias("html_paragraphs"))
    return docs.join(counts, "id", "left").na.fill(0, ["child_count", "pdf_paragraphs", "html_paragraphs"])


def canonical_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, is_canonical, reason for every node.

    A document is canonical if it ranks first of its title. A paragraph or section isn't if it hangs on duplicate
    documents only, or if it was extracted from a PDF while its document's title also has web paragraphs.
    """
    ranks = document_rank(document_children(nodes, edges)).select("id", "rank")
    parent = edges.where("edge_type = 'contains'").select(F.col("from_node_id").alias("doc"), F.col("to_node_id").alias("id")).join(ranks.toDF("doc", "prank"), "doc")
    on = parent.groupBy("id").agg(F.max((F.col("prank") == 1).cast("int")).alias("has_canonical"), F.max((F.col("prank") > 1).cast("int")).alias("has_duplicate"))
    kind = F.col("node_type").isin("guidance_paragraph", "guidance_section")
    meta = nodes.select("id", "node_type", F.get_json_object("metadata_json", "$.document_title").alias("doc_title"), F.coalesce(F.get_json_object("metadata_json", "$.source") == "pdf_text_extraction", F.lit(False)).alias("pdf"))
    html = meta.where((F.col("node_type") == "guidance_paragraph") & ~F.col("pdf") & F.col("doc_title").isNotNull()).select("doc_title").distinct().withColumn("html", F.lit(True))
    all_ = meta.join(ranks, "id", "left").join(on, "id", "left").join(html, "doc_title", "left")
    reason = (
        F.when((F.col("node_type") == "guidance_document") & (F.coalesce("rank", F.lit(2)) > 1), "duplicate_title")
        .when(kind & (F.coalesce("has_canonical", F.lit(1)) == 0) & (F.coalesce("has_duplicate", F.lit(0)) == 1), "duplicate_document_child")
        .when(kind & F.col("pdf") & F.coalesce("html", F.lit(False)), "pdf_suppressed")
        .otherwise("canonical")
    )
    return all_.select("id", "node_type", reason.alias("reason"), (reason == "canonical").cast("int").alias("is_canonical"))


#: File types of spreadsheets, and of files that people read (fixed values).
WORKBOOKS = ("xlsx", "xls", "xlsm", "csv")
READ_BY_PEOPLE = ("pdf", "html", *WORKBOOKS, "doc", "docx")


def source_kind(file_type: Column, title: Column, url: Column) -> Column:
    """The kind of a source document by its file type and the words of its title and URL."""
    f, x = F.lower(F.trim(F.coalesce(file_type, F.lit("")))), F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(url, F.lit(""))))
    has = lambda *words: reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words])
    pdf, page = f == "pdf", f == "html"
    return ladder(
        [
            (f == "xml", "taxonomy_xml"),
            (f == "xsd", "taxonomy_schema"),
            (f.isin("xbrl", "zip") | has("taxonomy", "xbrl", "dpm"), "taxonomy_package"),
            (f.isin(*WORKBOOKS), "template_workbook"),
            (pdf & x.rlike(r"\b(instruction|instructions|guidance|guidelines|notes)\b"), "instruction_pdf"),
            (pdf & x.rlike(r"\b(template|templates|workbook|data item)\b"), "template_pdf"),
            (pdf & x.rlike(r"\b(cp|ps|ss|sop)\d+/?\d+\b"), "policy_pdf"),
            (pdf, "pdf_document"),
            (page & has("/rules", "/pra-rules"), "rulebook_html"),
            (page & has("/publication/"), "policy_html"),
            (page, "webpage_html"),
        ],
        "other_source",
    )


def source_groups(sources: DataFrame) -> DataFrame:
    """source_id, source_kind, dedupe_key, canonical_id, decision of sources(source_id, url, checksum, file_type, title).

    Sources are the same by their URL, else by the checksum of files that people read, with equal type, kind and title.
    Taxonomy files other than archives stay by themselves. Of a group the one without a version mark in its id, with
    the longest title, with the smallest id is canonical. The best is found by an aggregate and joined back, so that a
    key with many sources is no one task's work.
    """
    f = F.lower(F.trim(F.coalesce("file_type", F.lit(""))))
    s = sources.withColumn("source_kind", source_kind(F.col("file_type"), F.col("title"), F.col("url")))
    taxonomy = F.col("source_kind").startswith("taxonomy")
    url, checksum = normalise_url(F.col("url")), F.lower(F.trim(F.coalesce("checksum", F.lit(""))))
    title = F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), "[^a-z0-9]+", "")
    own = F.concat(F.lit("source:"), "source_id")
    by_sum = F.concat_ws(":", F.lit("checksum"), f, "source_kind", checksum, title)
    key = F.when(taxonomy & (f != "zip"), own).when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("url:"), url)).when((checksum != "") & f.isin(*READ_BY_PEOPLE) & ~taxonomy, by_sum).otherwise(own)
    s = s.withColumn("dedupe_key", key)
    order = F.struct(F.contains("source_id", F.lit("-v-")).cast("int").alias("v"), (-F.length(F.coalesce("title", F.lit("")))).alias("l"), F.col("source_id"))
    best = s.groupBy("dedupe_key").agg(F.min(order)["source_id"].alias("canonical_id"))
    by = F.concat(F.lit("duplicate_"), F.split("dedupe_key", ":")[0])
    decision = F.when(F.col("source_id") == F.col("canonical_id"), "canonical").otherwise(by)
    return s.join(best, "dedupe_key").withColumn("decision", decision)
