"""Lookups, derived texts and named functions on small tables and awkward input."""

import json

from pyspark.sql import functions as F

from lexgraph.functions import rules as R
from lexgraph.operators import lookup as L

NODE = "id string, node_type string, title string, text string, url string, metadata_json string"


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(f(F.col("v"))).collect()]


def test_named_functions(spark):
    assert column(spark, ["https://x.org/a/b/?p=1&q=2", None, "https://x.org"], R.cache_name) == ["a__b__p-1_q-2.html", "index.html", "index.html"]
    assert column(spark, ["HTTPS://X.org/A?b#c", None], R.canonical_url) == ["https://x.org/A?b", ""]
    assert column(spark, ["https://x/d-v12.pdf?a", "https://x/d.pdf", None], R.document_version) == [12, 0, 0]
    assert [tuple(x) if x else None for x in column(spark, ["x/banking_3.4.10_hotfix.zip", "x/bankingv321", "x", None], R.package_version)] == [(3, 4, 10, 1), (3, 2, 1, 0), None, None]
    assert column(spark, ["Very high", "medium", " low", "0.42", "x", None], R.confidence_number) == [0.9, 0.65, 0.35, 0.42, 0.0, 0.0]
    assert column(spark, ["C_04.00", "PRA 101", "P 35.10.1", "none", None], R.template_number) == ["4", "101", "35.10.1", "", ""]
    assert column(spark, ["on 2024-05-06 and 2025-01-01", "1999-01-01", None], R.iso_date) == ["2024-05-06", None, None]
    assert column(spark, ["01/02/2024 to 3/4/2024 or 05/06/2025", None], R.written_dates) == [["01/02/2024", "05/06/2025"], []]
    assert column(spark, [" 12 ", "PRA  Supervisory Statement 1", "Bank of England | x", " a  b", None], R.page_line) == ["", "", "", "a b", ""]
    assert column(spark, ["Report (PDF) (1.2MB)", "Form [xlsx 3 kb] ", "Rules opens in a new window", None], R.link_title) == ["Report", "Form", "Rules", ""]
    got = spark.createDataFrame([("https://x/a.pdf", 403, ""), ("https://x/a.aspx", 403, ""), ("https://x/a", 404, ""), ("https://x/a", 500, ""), ("https://x/a", 200, "Page not found"), ("https://x/a", 200, ""), ("https://x/a", None, "")], "u string, s int, t string").select(R.link_status(F.col("u"), F.col("u"), F.col("s"), F.col("t"), F.lit("")))
    assert [r[0] for r in got.collect()] == ["ok", "broken", "broken", "suspect", "soft_404", "ok", "error"]
    reason = lambda k, t: R.unresolved_reason(F.lit(k), t, F.lit(""), F.lit(""))
    assert column(spark, ["", "the CRR", "that Regulation applies", "x1", None, "Article 5"], lambda c: reason("rule", c))[::5] == ["noisy_fragment", None]


def test_points_and_names(spark):
    n = spark.createDataFrame([("a", "rule", "A"), ("x", "rule", "X")], "id string, kind string, label string")
    g = spark.createDataFrame([("x", "Template", "GX"), ("data_item:COR1", "DataItem", "Cor")], "id string, kind string, label string")
    asked = spark.createDataFrame([("a",), ("x",), ("cor1",), ("none",), (None,)], "id string")
    got = {r["asked"]: (r["id"], r["source"]) for r in L.point({"rulebook": n, "reporting": g}, asked).collect()}
    assert got == {"a": ("a", "rulebook"), "x": ("x", "reporting"), "cor1": ("data_item:COR1", "reporting")}
    assert L.point({"rulebook": n, "reporting": g}, asked.where("id = 'x'"), ["rulebook"]).first()["source"] == "rulebook" and L.chosen_sources(["nonsense"]) == ["rulebook", "reporting"]
    nodes = spark.createDataFrame([("data_item:COR1", "DataItem", "Cor"), ("template:C1", "Template", "C 01.00"), ("n", "Other", "Label")], "id string, node_type string, label string")
    names = spark.createDataFrame([("n",), ("cor1",), ("c1",), ("c 01.00",), ("LABEL",), ("none",), (None,)], "name string")
    assert {r["name"]: (r["id"], r["how"]) for r in L.resolve_names(nodes, names).collect()} == {"n": ("n", "id"), "cor1": ("data_item:COR1", "data_item"), "c1": ("template:C1", "template"), "c 01.00": ("template:C1", "template"), "LABEL": ("n", "label")}


def test_texts(spark):
    n = spark.createDataFrame([("p", "chapter", "P", " ", None, None), ("b", "rule", "B", "text b", None, json.dumps({"part_title": "Audit"})), ("a", "rule", "A", None, None, None), ("e", "rule", None, None, None, "{bad")], NODE)
    e = spark.createDataFrame([("p", "b", "contains", "site_structure"), ("p", "a", "contains", "site_structure"), ("p", "a", "contains", "site_structure"), ("p", "e", "contains", "site_structure")], "from_node_id string, to_node_id string, edge_type string, source_method string")
    got = {r["id"]: (r["text"], r["derived"]) for r in L.derived_text(n, e).collect()}
    assert got == {"p": ("A\n\nB\ntext b", True), "b": ("text b", False), "a": (None, False), "e": (None, False)}
    text = {r["id"]: r["text"] for r in L.embedding_text(n, L.parent_chapters(n, e)).collect()}
    assert text["b"] == "PRA Rulebook Part: Audit\nChapter: P\nNode type: rule\nTitle: B\ntext b" and text["e"] == "Chapter: P\nNode type: rule\nTitle: "
    assert L.derived_text(n.limit(0), e.limit(0)).count() == 0


def test_placeholders_and_families(spark):
    n = spark.createDataFrame([("t", "rule", "", "", "https://x/a/01-01-2024#q", '{"html_id": "q"}'), ("d1", "rule", "", "", "https://x/b", '{"html_id": "r"}'), ("d2", "rule", "", "", "https://x/b", '{"html_id": "r"}'), ("p", "rule_reference", "", "", "https://x/a#q", None), ("m", "rule_reference", "", "", "https://x/b#r", None), ("u", "rule_reference", "", "", None, None)], NODE)
    assert [tuple(r) for r in L.placeholder_targets(n).collect()] == [("p", "t", "dated_html_id_url")]
    e = spark.createDataFrame([("t", "d1"), ("d2", "p")], "from_node_id string, to_node_id string")
    left = L.without_family({"node": (n, ["id"]), "edge": (e, ["from_node_id", "to_node_id"])}, n.where("id = 'd1'").select("id"))
    assert left["node"].count() == 5 and [tuple(r) for r in left["edge"].collect()] == [("d2", "p")]


def test_edges(spark):
    g = spark.createDataFrame([("e1", "a", "b", "X", " S1 ", 0.9, None), ("e2", "a", "c", "Y", "", None, "accepted"), ("e3", "c", "a", "X", "none", 0.3, " ")], "edge_id string, source_node_id string, target_node_id string, edge_type string, evidence_span_id string, confidence double, review_status string")
    s = spark.createDataFrame([("s1", "d", 3, "H", None, "Raw")], "span_id string, source_id string, page_number int, heading_path string, normalised_text string, raw_text string")
    assert {r["edge_id"]: r["quote"] for r in L.edge_evidence(g, s).collect()} == {"e1": "Raw", "e2": None, "e3": None}
    assert {r["edge_id"]: (r["review_status"], r["confidence"]) for r in L.with_policy(g).collect()} == {"e1": ("unreviewed", 0.9), "e2": ("needs_review", 0.0), "e3": ("unreviewed", 0.3)}
    assert [r["id"] for r in L.adjacent(g, "a").collect()] == ["b", "c"] and [r["id"] for r in L.adjacent(g, "a", ("X",), out=False).collect()] == ["c"]
    c = spark.createDataFrame([("a", "b", "X"), ("b", "c", "X"), ("b", "c", "X"), ("a", "zz", "X"), ("", "a", "X")], "source string, target string, edge_type string")
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert [tuple(r) for r in L.missing_edges(c, n, g).collect()] == [("b", "c", "X")]
    spans = spark.createDataFrame([("1", "d", "Ledger and Liquidity of a firm"), ("2", "d", "liquidity ledger"), ("3", "e", "ledger"), ("4", "f", None)], "span_id string, source_id string, raw_text string")
    assert {tuple(r) for r in L.best_spans(spans, ["liquidity", "ledger"], F.col("raw_text"), "source_id").collect()} == {("d", "2", True), ("e", "3", False)}
