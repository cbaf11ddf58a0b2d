"""Lookups over both graphs: points, neighbours, evidence, names of nodes, texts made from children and for embedding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_blank

SOURCES = ("rulebook", "reporting")


def chosen_sources(names: list[str] | None) -> list[str]:
    """The sources asked for; both where none or only unknown ones are named."""
    wanted = [s for s in SOURCES if s in (names or [])]
    return wanted or list(SOURCES)


def point(parts: dict[str, DataFrame], wanted: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """id, source, kind, label of the wanted(id) records in parts(id, kind, label) by source.

    The reporting graph wins where both know an id; what none knows is looked up once more as a data item in capitals.
    """
    known = [parts[s].select("id", F.lit(s).alias("source"), F.lit(0 if s == "reporting" else 1).alias("nth"), "kind", "label") for s in chosen_sources(sources) if s in parts]
    every = reduce(lambda a, b: a.unionByName(b), known)
    asked = wanted.select(F.col("id").alias("asked"), F.col("id").alias("id"), F.lit(0).alias("step"))
    items = wanted.where(~F.startswith("id", F.lit("data_item:"))).select(F.col("id").alias("asked"), F.concat(F.lit("data_item:"), F.upper("id")).alias("id"), F.lit(1).alias("step"))
    met = asked.unionByName(items).join(every, "id")
    return met.withColumn("k", F.row_number().over(W.partitionBy("asked").orderBy("step", "nth"))).where("k = 1").select("asked", "id", "source", "kind", "label")


def resolve_names(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """name, id, how: nodes(id, node_type, label) meant by names(name): by id, as data item, as template, by label.

    Templates and labels are compared without case; of several the smallest id counts.
    """
    n = nodes.select("id", "node_type", "label")
    up = lambda c: F.upper(F.col(c))
    q = names.select("name").distinct()
    steps = [
        ("id", q.join(n.select("id"), F.col("name") == F.col("id"))),
        ("data_item", q.withColumn("k", F.when(F.startswith("name", F.lit("data_item:")), F.col("name")).otherwise(F.concat(F.lit("data_item:"), up("name")))).join(n.select("id"), F.col("k") == F.col("id")).drop("k")),
        ("template", q.withColumn("k", F.explode(F.array(F.concat(F.lit("TEMPLATE:"), up("name")), up("name")))).join(n.where("node_type = 'Template'").select("id", F.explode(F.array(up("id"), up("label"))).alias("k")), "k").drop("k")),
        ("label", q.withColumn("k", up("name")).join(n.select("id", up("label").alias("k")), "k").drop("k")),
    ]
    found = reduce(lambda a, b: a.unionByName(b), [d.select("name", "id", F.lit(h).alias("how"), F.lit(i).alias("step")) for i, (h, d) in enumerate(steps)])
    best = F.min(F.struct("step", "id", "how"))
    return found.groupBy("name").agg(best.alias("b")).select("name", "b.id", "b.how")


def derived_text(nodes: DataFrame, edges: DataFrame, most: int = 30) -> DataFrame:
    """id, text, derived: a node's text, or where it is blank that of its first `most` children by title (a report limit)."""
    child = nodes.select(F.col("id").alias("to_node_id"), "title", F.col("text").alias("body")).where(~is_blank(F.col("title")) | ~is_blank(F.col("body")))
    bare = nodes.where(is_blank(F.col("text"))).select(F.col("id").alias("from_node_id"))
    inside = edges.where("edge_type = 'contains'").select("from_node_id", "to_node_id").distinct().join(bare, "from_node_id", "left_semi").join(child, "to_node_id")
    nth = F.row_number().over(W.partitionBy("from_node_id").orderBy("title", "to_node_id"))
    first = inside.withColumn("k", nth).where(F.col("k") <= most)
    piece = F.when(is_blank(F.col("body")), F.coalesce("title", F.lit(""))).otherwise(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.col("body")))
    made = first.groupBy(F.col("from_node_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", piece.alias("p")))), lambda x: x["p"]), "\n\n").alias("made"))
    return nodes.select("id", "text").join(made, "id", "left").select("id", F.coalesce("made", "text").alias("text"), F.col("made").isNotNull().alias("derived"))


def parent_chapters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, chapter: the first chapter by title that holds a node in the site's structure."""
    up = edges.where("edge_type = 'contains' and source_method = 'site_structure'").select(F.col("from_node_id").alias("p"), F.col("to_node_id").alias("id"))
    return up.join(nodes.where("node_type = 'chapter'").select(F.col("id").alias("p"), "title"), "p").groupBy("id").agg(F.min("title").alias("chapter"))


def embedding_text(nodes: DataFrame, chapters: DataFrame, most: int | None = None) -> DataFrame:
    """id, text: a node's text behind the lines that tell it from others: Part, document, chapter, source, type, title."""
    meta = lambda f: F.get_json_object("metadata_json", f"$.{f}")
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name), c))
    n = nodes.join(chapters, "id", "left")
    lines = [line("PRA Rulebook Part: ", meta("part_title")), line("PRA supervisory statement or guidance document: ", meta("document_title")), line("Chapter: ", F.col("chapter")), F.when(F.col("node_type") == "defined_term", line("Defined term source: ", meta("source"))), F.concat(F.lit("Node type: "), F.coalesce("node_type", F.lit(""))), F.concat(F.lit("Title: "), F.coalesce("title", F.lit(""))), F.nullif(F.coalesce("text", F.lit("")), F.lit(""))]
    whole = F.concat_ws("\n", *lines)
    return n.select("id", (whole if most is None else F.substring(whole, 1, most)).alias("text"))


def adjacent(edges: DataFrame, node: str, types: tuple[str, ...] = (), out: bool = True, most: int = 100) -> DataFrame:
    """id, edge_id, edge_type, confidence: the ends of a node's edges in one direction (a page of fixed length)."""
    at, other = ("source_node_id", "target_node_id") if out else ("target_node_id", "source_node_id")
    e = edges.where(F.col(at) == node)
    if types:
        e = e.where(F.col("edge_type").isin(*types))
    return e.select(F.col(other).alias("id"), "edge_id", "edge_type", "confidence").orderBy("id", "edge_id").limit(most)


def edge_evidence(edges: DataFrame, spans: DataFrame) -> DataFrame:
    """edge_id, source, target, edge_type, span_id, page_number, heading_path, quote: edges with the span that shows them."""
    key = lambda c: F.lower(F.trim(c))
    s = spans.select(key(F.col("span_id")).alias("k"), "span_id", "source_id", "page_number", "heading_path", F.coalesce("normalised_text", "raw_text").alias("quote"))
    return edges.withColumn("k", key(F.col("evidence_span_id"))).join(s, "k", "left").select("edge_id", "source_node_id", "target_node_id", "edge_type", "span_id", "source_id", "page_number", "heading_path", "quote")


def with_policy(edges: DataFrame) -> DataFrame:
    """Edges without evidence need review and have a confidence of at most 0.55; all are unreviewed at least."""
    none = is_blank(F.col("evidence_span_id"))
    c = F.coalesce("confidence", F.lit(0.0))
    return edges.withColumn("review_status", F.when(none, "needs_review").otherwise(F.coalesce(F.nullif(F.trim("review_status"), F.lit("")), F.lit("unreviewed")))).withColumn("confidence", F.when(none, F.least(c, F.lit(0.55))).otherwise(c))


def best_spans(spans: DataFrame, terms: list[str], text: Column, by: str) -> DataFrame:
    """by, span_id, all_terms: of each group the shortest span with all terms, else with the first of them that occurs."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = [F.contains(low, F.lit(t.lower())) for t in terms]
    every = reduce(lambda a, b: a & b, has)
    rank = F.when(every, 0)
    for k, h in enumerate(has, 1):
        rank = rank.when(h, k)
    best = F.min(F.struct(rank.alias("rank"), F.length(low).alias("size"), F.col("span_id")))
    return spans.where(rank.isNotNull()).groupBy(by).agg(best.alias("b")).select(by, "b.span_id", (F.col("b.rank") == 0).alias("all_terms"))


def missing_edges(candidates: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates(source, target, edge_type, ...) whose both ends are nodes and that no edge states yet, each once."""
    c = candidates.where((F.trim("source") != "") & (F.trim("target") != ""))
    known = nodes.select("id")
    c = c.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    have = edges.select(F.col("source_node_id").alias("source"), F.col("target_node_id").alias("target"), "edge_type").distinct()
    return c.join(have, ["source", "target", "edge_type"], "left_anti").dropDuplicates(["source", "target", "edge_type"])


def undated(url: Column) -> Column:
    """A URL's address without a date at its end."""
    return F.regexp_replace(url, r"/\d{2}-\d{2}-\d{4}/?$", "")


def placeholder_targets(nodes: DataFrame) -> DataFrame:
    """id, target_id, basis: placeholders resolved to the one node with their address and anchor, dated or not."""
    meta = F.get_json_object("metadata_json", "$.html_id")
    base, anchor = F.regexp_replace(F.split("url", "#")[0], "/+$", ""), F.regexp_extract("url", r"#(.+)$", 1)
    real = nodes.where("node_type <> 'rule_reference' and url is not null").select(F.col("id").alias("target_id"), base.alias("base"), meta.alias("anchor")).where("anchor <> ''")
    held = nodes.where("node_type = 'rule_reference'").select("id", base.alias("base"), anchor.alias("anchor")).where("anchor <> ''")
    dated = real.withColumn("plain", undated(F.col("base"))).where("plain <> base").select("target_id", F.col("plain").alias("base"), "anchor")

    def unique(df: DataFrame) -> DataFrame:
        return df.groupBy("base", "anchor").agg(F.count("*").alias("n"), F.min("target_id").alias("target_id"))

    exact = held.join(unique(real), ["base", "anchor"])
    rest = held.join(exact.select("id"), "id", "left_anti").join(unique(dated), ["base", "anchor"])
    both = exact.withColumn("basis", F.lit("exact_html_id_url")).unionByName(rest.withColumn("basis", F.lit("dated_html_id_url")))
    return both.where("n = 1").select("id", "target_id", "basis")


def inverted_index(nodes: DataFrame, buckets: int = 64) -> DataFrame:
    """term, bucket, df, postings(id, tf) of titles and texts; written by bucket, a term's list is found in one folder."""
    words = F.filter(F.split(F.lower(F.concat_ws(" ", "title", "text")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    each = nodes.select("id", F.explode(words).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    return each.select("term", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), "id", "tf")


def without_family(tables: dict[str, tuple[DataFrame, list[str]]], doomed: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows that refer in any of its key columns to a doomed(id)."""
    d = doomed.select("id").distinct()
    out = {}
    for name, (df, keys) in tables.items():
        for k in keys:
            df = df.join(d.withColumnRenamed("id", k), k, "left_anti").select(*df.columns)
        out[name] = df
    return out
