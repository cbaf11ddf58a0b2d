"""Resolution, URL propagation and segmentation on small tables."""

from lexgraph.operators import resolve

NODE = "id string, node_type string, title string, url string, metadata_json string"
EDGE = "id string, from_node_id string, to_node_id string, source_url string"


REF = "ref_id string, source_id string, ref_index int, text string, ident string, doc string, evidence string, kind string, extracted double"


def resolved(spark, nodes, refs):
    n = spark.createDataFrame([(i, k, t, None, m) for i, k, t, m in nodes], NODE)
    r = spark.createDataFrame([(str(i), s, i, x, ident, doc, ev, kind, 0.95) for i, (s, x, ident, doc, ev, kind) in enumerate(refs)], REF)
    return {int(x["ref_id"]): (x["target_id"], x["method"], x["score"]) for x in resolve.resolve(r, n).collect()}


def test_articles_of_the_regulation_and_of_the_parts_that_restate_it(spark):
    lcr = '{"part_title": "Liquidity Coverage Ratio (CRR)"}'
    nodes = [("d", "rule", "2.7", '{"part_title": "Disclosure (CRR)"}'), ("l", "rule", "2.5", '{"part_title": "Liquidity (CRR)"}'), ("s", "rule", "Article 8(6)", '{"part_title": "Liquidity Coverage Ratio (CRR)", "rule_number": "6"}'), ("a11", "rule", "Article 11(2)", lcr), ("a8", "chapter", "Article 8 Operational Requirements", lcr), ("a28", "rule", "Article 28(8)", '{"part_title": "Liquidity Coverage Ratio (CRR)", "rule_number": "8"}')]
    refs = [
        ("d", "Article 11(2) of the CRR", "Article 11(2)", "CRR", None, "article"),
        ("l", "Liquidity Coverage Ratio (CRR) Article 11(2)", "Article 11(2)", "Liquidity Coverage Ratio (CRR)", None, "article"),
        ("l", "Article 415(2) of CRR", "Article 415(2)", "CRR", None, "article"),
        ("s", "Article 8 of Regulation (EU) No 2015/61", "Article 8 of Regulation (EU) No 2015/61", "", "Article 8 of Regulation (EU) No 2015/61", "regulation"),
    ]
    got = resolved(spark, nodes, refs)
    assert got == {0: ("external:uk-crr:article:11:2", "uk_crr_external_article", 0.99), 1: ("a11", "exact_node_title", 0.945), 2: ("external:uk-crr:article:415:2", "uk_crr_external_article", 0.99), 3: ("a8", "article_with_part_context", 0.9)}


def test_generators_and_their_order(spark):
    audit = '{"part_title": "Audit"}'
    nodes = [("r", "rule", "Audit 3.4", '{"part_title": "Audit", "rule_number": "3.4"}'), ("r2", "rule", "Other 3.4", '{"part_title": "Other", "rule_number": "3.4."}'), ("p", "part", "Audit", None), ("g", "guidance_document", "PS5/16 – Valuation", None), ("c", "chapter", "3 Scope", audit), ("t", "defined_term", "ledger", None), ("s", "rule", "Audit 1.1", audit), ("d1", "chapter", "Same", audit), ("d2", "rule", "Same", audit)]
    refs = [
        ("s", "see 3.4", "3.4", "audit", None, "rule"),  # the number within the Part, not the Part
        ("s", "see 3.4", "3.4", "", None, "rule"),  # within the source's own Part
        ("x", "see 3.4", "3.4", "", None, "rule"),  # no context: the smallest id
        ("s", "the Audit Part", "Audit", "", None, "part"),
        ("s", "under ps5/16", "", "", None, "guidance"),
        ("s", "chapter 3", "3", "Audit", None, "chapter"),
        ("s", "Ledger", "", "", None, "definition"),
        ("s", "Same", "Same", "", None, "unknown"),  # equal scores: the rule
        ("r", "see 3.4", "3.4", "Audit", None, "rule"),  # never the source itself
        ("s", "3.4", "3.4", "Audit", None, "form"),  # another kind
        (None, None, None, None, None, None),
    ]
    got = resolved(spark, nodes, refs)
    ctx, none = "provision_identifier_with_context", "provision_identifier_no_context"
    assert got == {0: ("r", ctx, 0.975), 1: ("r", ctx, 0.975), 2: ("r", none, 0.74), 3: ("p", "exact_part_title", 0.9), 4: ("g", "guidance_code_title", 0.91), 5: ("c", ctx, 0.975), 6: ("t", "exact_defined_term_title", 0.985), 7: ("d2", "exact_node_title", 0.945), 9: ("r", ctx, 0.955)}
    assert resolved(spark, nodes, [refs[-1]]) == {}


def test_stage(spark):
    found = spark.createDataFrame([("1", "r", "exact_node_title", 0.945), ("2", "r", "exact_part_title", 0.9), ("3", "g", "exact_node_title", 0.945), ("4", "p", "article_title_no_part_context", 0.72)], "ref_id string, target_id string, method string, score double")
    refs = spark.createDataFrame([(str(i), "s", i, "text", None, None, q, None, c) for i, q, c in ((1, "one", 0.9), (2, "", 0.99), (3, "x", 0.9), (4, "y", 0.9))], REF)
    have = spark.createDataFrame([("e", "s", "g", None)], EDGE)
    assert [tuple(r) for r in resolve.stage(found, refs, have).collect()] == [("s", "r", 0.891, 2, "exact_node_title,exact_part_title", "one\n---\ntext")]


def test_urls(spark):
    n = spark.createDataFrame([("a", "t", "", "http://a", None), ("b", "t", "", "", None), ("c", "t", "", None, None), ("d", "t", "", "ftp://d", None)], NODE)
    e = spark.createDataFrame([("1", "a", "b", None), ("2", "c", "d", " https://e ")], EDGE)
    assert {r["id"]: (r["url"], r["origin"]) for r in resolve.propagate_urls(n, e).collect()} == {"a": ("http://a", "own"), "b": ("http://a", "neighbour"), "c": ("https://e", "edge"), "d": ("https://e", "edge")}


def test_segments(spark):
    lines = ["SCOPE OF RULES", "The firm must act.", "1.2 A rule of", "two lines.", "Page 3 of 9", "short tail", *["long line of running text " * 3] * 40]
    got = resolve.segment_lines(lines)
    assert got[0] == ("heading", "SCOPE OF RULES") and got[2][1].startswith("1.2 A rule of two lines. short tail") and all(len(t) <= 1900 for _, t in got)
    s = spark.createDataFrame([("s", "page", 2, 0, "b", "world."), ("s", "page", 1, 0, "a", "hello"), ("s", "page", 3, 0, "c", None), (None, "page", 1, 0, "d", "x")], "source_id string, span_type string, page_number int, start_offset int, span_id string, raw_text string")
    assert [r["text"] for r in resolve.segment_sources(s).collect()] == ["hello world."]
    assert resolve.segment_sources(s.limit(0)).count() == 0
