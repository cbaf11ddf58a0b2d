"""Pages of a rulebook site to nodes and edges."""

import json

from lexgraph.sources import rulebook as R

URL = "https://r.example/pra-rules/audit/01-06-2026"
PART = """<h1>Audit</h1><div class="rulebook-content" data-rulebook-date="01/06/2026">
<div class="chapter-section" id="c1"><span class="chapter-number">1</span><h2 class="chapter-heading">Scope</h2></div>
<div class="row-block" id="r11"><div class="rule-number">1.1</div><div class="div-row__col-2">A <a href="#glossary-term-7" title="firm">firm</a> &amp; more, see <a href="/pra-rules/b#x1">B 2</a>, <a href="https://x.org/z">z</a>, <a href="mailto:a@b">m</a>. 01/01/2020</div></div>
<div class="row-block" id="h9"><h3>Heading</h3></div>
<div class="chapter-section" id="a2"><h2 class="chapter-heading">Article 2 Meaning</h2></div>
<div class="row-block" id="r2"><div class="rule-number">3.1.</div><div class="div-row__col-2"><p><a class="glossary-link" href="#g">ledger</a>:</p><p>means a book.</p><p>Another text.</p></div></div>
<div class="row-block" id="u1"><div class="rule-number">[Note]</div><div class="div-row__col-2">A text that is long enough to stay.</div></div>
</div>"""


def parsed(kind, url, html):
    got = R.read_page(kind, url, html)
    return [r for r in got if r["record"] == "node"], [r for r in got if r["record"] == "edge"]


def test_part():
    n, e = parsed("part", URL, PART)
    by = {x["stable_key"]: x for x in n}
    key = "part:pra-rules/audit/01-06-2026"
    assert json.loads(by[key]["metadata_json"])["rulebook_date"] == "01/06/2026"
    assert by[f"chapter:{key}:1"]["title"] == "Scope" and by[f"chapter:{key}:heading:h9"]["title"] == "Heading"
    rule = by[f"rule:{key}:1.1"]
    assert rule["title"] == "1.1" and rule["text"].startswith("A firm & more, see B 2 , z") and json.loads(rule["metadata_json"])["effective_dates"] == ["01/01/2020"]
    shown = {x["title"] for x in n if x["kind"] == "rule"}
    assert shown == {"1.1", "Article 2(3)(1)", "Article 2 Meaning"}
    links = {(x["kind"], x["confidence"], json.loads(x["metadata_json"]).get("target_key")) for x in e if x["from_node_id"] == rule["id"] and x["kind"] != "contains"}
    assert links == {("uses_defined_term", 1.0, "defined_term:glossary:firm"), ("references", 1.0, "url:pra-rules/b#x1"), ("references", 0.8, "external:https://x.org/z")}
    term = by[f"defined_term:part:{key}:ledger"]
    assert term["text"] == "means a book." and {x["kind"] for x in e if x["to_node_id"] == term["id"]} == {"defines", "uses_defined_term"}
    assert all(x["id"] == R.edge_key(x["from_node_id"], x["to_node_id"], "contains") for x in e if x["kind"] == "contains")


def test_guidance_and_lists():
    n, e = parsed("guidance", "https://r.example/guidance/supervisory-statements/ss1/2026", PART)
    assert [x["kind"] for x in n] == ["guidance_document", "guidance_section", "guidance_paragraph", "guidance_section", "guidance_paragraph", "guidance_paragraph"]
    assert n[2]["title"] == "Audit 1.1" and json.loads(n[0]["metadata_json"])["document_type"] == "supervisory_statement"
    n, e = parsed("rulebook_index", "https://r.example/pra-rules", "<a href='/pra-rules/audit'><span>CRR Firms</span> <b>Audit</b></a><a href='/pra-rules/crr-firms'>CRR</a><a href='/other'>x</a>")
    assert [x["title"] for x in n] == ["PRA Rules", "Audit"] and json.loads(n[1]["metadata_json"])["firm_categories"] == ["CRR Firms"] and len(e) == 1
    n, _ = parsed("guidance_index", "https://r.example/guidance", "<div class='search-results'><a href='/guidance/statements-of-policy/x'><h3>X</h3><i class='release-tag'>T</i></a></div>")
    assert n[1]["title"] == "X" and json.loads(n[1]["metadata_json"]) == {"document_type": "statement_of_policy", "firm_categories": ["T"]}
    rows = "<div class='row-block'><div class='rule-number'>Definition</div><div class='div-row__col-2'>x</div></div><div class='row-block'><div class='rule-number'>Firm</div><div class='div-row__col-2'>means a body.</div></div>"
    n, e = parsed("glossary", "https://r.example/glossary", rows)
    assert [x["stable_key"] for x in n] == ["glossary", "defined_term:glossary:firm"] and e[0]["kind"] == "defines"
    n, e = parsed("crr_terms", "https://r.example/crr", "<div><h3>Firm</h3><p>means a body.</p><p>PDF x</p><h3>Other</h3><p>short</p></div>")
    assert [(x["stable_key"], x["text"]) for x in n] == [("crr_terms_list", ""), ("defined_term:crr:firm", "means a body.")] and e[0]["source_method"] == "crr_terms_source"
    card = "<div class='card-block'><a class='card-block__link' href='/i/1'><b class='card-block__title'>I 1</b></a><i class='card-block__date'>May</i><i class='card-block__sub-title'>Effective June</i><div class='card-block__bottom'><a href='/pra-rules/audit'>Audit</a><a href='/glossary'>G</a><a href='https://x.org'>X</a></div></div>"
    n, e = parsed("instrument", "https://r.example/li", card)
    assert [(x["kind"], x["confidence"]) for x in e] == [("contains", 1.0), ("amends", 1.0), ("amends", 1.0), ("references", 0.9)] and json.loads(n[1]["metadata_json"]) == {"published": "May", "effective": ["Effective June"]}


def test_site(spark):
    rows = [("part", URL, PART), ("part", URL + "/", PART), ("part", URL, None), ("nothing", URL, PART), (None, URL, PART), ("part", None, PART), ("glossary", "https://r.example/glossary", "<div <<p>broken")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "source_type string, url string, raw_html string, id int")
    n, e = R.read_site(df)
    assert n.count() == n.select("id").distinct().count() and n.where("node_type = 'part'").count() == 1 and e.count() > 8
    n, e = R.read_site(df.limit(0))
    assert n.count() == 0 and e.count() == 0
