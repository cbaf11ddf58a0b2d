"""Repairs of references on small tables and awkward input."""

from pyspark.sql import functions as F

from lexgraph.operators import repair as P

URL = "https://r.example/pra-rules/a/01-06-2026"
EDGE = "id string, from_node_id string, to_node_id string, edge_type string, source_method string, evidence_text string, source_url string, metadata_json string"


def test_anchors(spark):
    link = lambda i, to, text, href: (i, "s", to, "references", "html_link", text, URL, f'{{"href": "{href}"}}')
    e = spark.createDataFrame([link("1", "p", "Target 4.2", "https://r.example/pra-rules/b"), link("2", "p", "Twice", "https://r.example/pra-rules/c"), link("3", "x", "(c)", "https://r.example/guidance/d#def"), link("4", "x", "Open", "https://r.example/pra-rules/e#zzz"), link("5", "t", "(c)", "https://r.example/q#abc"), ("6", "s", "x", "references", "html_link", None, None, "{bad"), link("7", "y", "self", "https://r.example/q#src")], EDGE)
    n = spark.createDataFrame([("t", '{"html_id": "abc"}'), ("u", '{"html_id": "def"}'), ("s", '{"html_id": "src"}'), ("z", None)], "id string, metadata_json string")
    pages = spark.createDataFrame([(URL, '<p><A class="k" href="/pra-rules/b#abc">Target <b>4.2</b></a> <a href="/pra-rules/c#x1">Twice</a> <a href="/pra-rules/c#x2">Twice</a></p>'), (None, None)], "url string, raw_html string")
    got = {r["replaces_edge_id"]: (r["to_node_id"], r["basis"]) for r in P.resolve_anchors(e, n, pages).collect()}
    assert got == {"1": ("t", "source_html_href"), "3": ("u", "link_anchor")}
    left = P.anchor_placeholders(e, P.resolve_anchors(e, n, pages)).collect()
    assert [(r["replaces_edge_id"], r["target_key"], r["title"]) for r in left] == [("4", "url:pra-rules/e#zzz", "Open")]
    assert P.resolve_anchors(e.limit(0), n, pages).count() == 0


def test_typed_and_materialised(spark):
    r = spark.createDataFrame([("a", "t", "Template", 0.9, 0.9), ("a", "t", "Template", 0.95, 0.99), ("a", "u", "Rule", 0.9, 0.5), ("a", "", "Rule", 0.9, 0.9), ("b", "v", None, 0.9, 0.8)], "source string, target string, target_type string, score double, extracted double")
    assert {tuple(x) for x in P.typed_edges(r).collect()} == {("a", "t", "REFERENCES_TEMPLATE", 0.93), ("b", "v", "REFERENCES_RULE", 0.72)}
    m = spark.createDataFrame([("article 5", "s1", "Art 5"), ("article 5", "s2", "Article 5"), ("article 6", "s1", "x"), ("ifrs:9", "s1", "IFRS 9"), ("", "s1", "y"), (None, "s1", "y")], "key string, source string, text string")
    assert {(x["key"], x["n"], x["examples"]) for x in P.materialised(m).collect()} == {("article 5", 2, "Art 5 | Article 5"), ("ifrs:9", 1, "IFRS 9")}


def test_robots_and_compact_lines(spark):
    u = spark.createDataFrame([("https://X.org/private/a",), ("https://x.org/open",), ("https://x.org/a/search.php?q",), ("https://y.org/private",), ("https://x.org",)], "url string")
    rules = spark.createDataFrame([("x.org", "/private/"), ("x.org", "/*/search.php"), ("y.org", "")], "host string, pattern string")
    assert {r["url"]: r["allowed"] for r in P.allowed_by_robots(u, rules).collect()} == {"https://X.org/private/a": False, "https://x.org/open": True, "https://x.org/a/search.php?q": False, "https://y.org/private": True, "https://x.org": True}
    lines = spark.createDataFrame([('{"id": "1", "references": [["t", "rule", "3.4"], ["u"]]}',), ("{broken",), ('{"id": "2", "references": []}',)], "value string")
    got = {tuple(r)[:4] for r in P.compact_lines(lines, ["text", "kind"]).select("id", "nth", "text", "kind").collect()}
    assert got == {("1", 0, "t", "rule"), ("1", 1, "u", None), (None, None, None, None)}
    assert P.compact_lines(lines, ["text"]).where(F.col("id").isNull()).first()["_corrupt"] == "{broken"
