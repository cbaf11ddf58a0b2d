"""Core operators on small hand-made tables."""

import json
import os
import random
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexgraph.functions import text as X
from lexgraph.operators import analytics, canonical, enrich, orphans, reporting, search, semantic, store, traverse
from lexgraph.sources import files, html
from lexgraph.streaming import events as stream

EDGE = "id string, from_node_id string, to_node_id string, edge_type string, source_method string, confidence double, evidence_text string"
T0, T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 2, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def chain(spark, n):
    return spark.createDataFrame([(f"e{i}", f"n{i:03}", f"n{i + 1:03}", "contains", "m", 1.0, "") for i in range(n)], EDGE)


def test_orphans(spark):
    refs = spark.createDataFrame([("e1", " N1 ", T1), ("e2", "gone", T1), ("e3", "n2", T1), ("e3", "n2", T2), ("e4", "n3", T1), ("e5", None, T1), ("e6", "  ", T1), ("e7", "n4", T1), ("e2", "gone", T1)], "id string, to_node_id string, loaded_at timestamp_ntz")
    nodes = spark.createDataFrame([("n1", T0), ("n2", T2), ("n3", T0), ("n4", T0), ("n4", T2), (None, T0)], "id string, loaded_at timestamp_ntz")
    gone = spark.createDataFrame([("node", "N3", T1), ("node", "n4", T1), ("other", "n1", T2), (None, None, None)], "table_name string, record_key string, removed_at timestamp_ntz")
    found = orphans.orphan_references(orphans.references(refs, "edge", "id", "to_node_id", "node"), orphans.parents(nodes, "node", "id", gone))
    assert rows(found.select("ref_id", "reason")) == [("e2", "missing"), ("e3", "later"), ("e4", "removed")]
    assert {r["period"] for r in orphans.orphan_counts(found).collect()} == {"2024-01"}


def test_orphans_empty_and_hot_key(spark):
    known = orphans.parents(spark.createDataFrame([], "id string, loaded_at timestamp_ntz"), "node", "id")
    hot = spark.range(3000).select(F.col("id").cast("string"), F.lit("x").alias("to_node_id"), F.lit(T0).alias("loaded_at"), F.lit(1).alias("key"), F.lit(2).alias("salt"))
    for src, n in ((hot, 3000), (hot.limit(0), 0)):
        assert orphans.orphan_references(orphans.references(src, "e", "id", "to_node_id", "node"), known).count() == n


def test_dedupe_merge_rewire(spark):
    e = spark.createDataFrame([("a", "1", "2", "t", "html", 1.0, "x"), ("b", "1", "2", "t", "html", 1.0, "x"), ("c", "1", "3", "t", "regex", 1.0, "y")], EDGE)
    once = store.drop_exact_duplicates(e, "id")
    assert rows(once.select("id")) == [("a",), ("c",)] == rows(store.drop_exact_duplicates(once, "id").select("id"))
    base, delta = (spark.createDataFrame(r, "id string, v string, first string") for r in ([("1", "old", "k1"), ("2", "old", "k2")], [("2", "new", "k9"), ("3", "new", "k3")]))
    assert rows(store.merge(base, delta, "id", ("first",))) == [("1", "old", "k1"), ("2", "new", "k2"), ("3", "new", "k3")]
    w = spark.createDataFrame([("a", "x", "y", "t", "m", 1.0, ""), ("b", "x2", "y", "t", "m", 1.0, ""), ("c", "x", "x2", "t", "m", 1.0, ""), ("d", "q", "q", "t", "m", 1.0, "")], EDGE)
    assert rows(store.rewire(w, spark.createDataFrame([("x2", "x")], "old_id string, new_id string")).select("id")) == [("a",), ("d",)]


def test_shadowed_placeholders_collapse_or_join(spark):
    e = spark.createDataFrame([("a", "1", "2", "r", "html", 0.5, "3.4"), ("b", "1", "2", "r", "regex", 0.9, "3.4"), ("c", "1", "9", "r", "regex", None, " "), ("d", "1", " ", "r", None, 1.0, "")], EDGE)
    left = store.drop_shadowed(e, F.col("source_method") == "regex", F.col("source_method") == "html", [F.col("from_node_id"), F.col("evidence_text")])
    assert rows(left.select("id")) == [("a",), ("c",), ("d",)]
    assert rows(store.placeholders(e, spark.createDataFrame([("2",)], "id string"))) == [("9", "external_reference", "9", 1)]
    got = {r["to_node_id"]: r for r in store.collapse_parallel(e).collect()}
    assert (got["2"]["n"], got["2"]["confidence"], got["2"]["edge_ids"]) == (2, 0.9, "a,b")
    l = spark.createDataFrame([("r1", "k", "k"), ("r2", "z", "k"), ("r3", None, None)], "id string, a string, b string")
    assert rows(store.or_join(l, [F.col("a"), F.col("b")], spark.createDataFrame([("k",)], "name string"), "name", "id").select("id")) == [("r1",), ("r2",)]


def test_traversal(spark):
    loop = spark.createDataFrame([("l", "z", "z", "t", "m", 1.0, "")], EDGE)
    got = dict(traverse.components(chain(spark, 40).unionByName(loop), spark.createDataFrame([("alone",)], "id string")).collect())
    assert {got[f"n{i:03}"] for i in range(41)} == {"n000"} and got["z"] == "z" and got["alone"] == "alone"
    e = chain(spark, 6)
    pairs = spark.createDataFrame([("n000", "n004"), ("n000", "n006"), ("n000", "n000"), ("n000", "no")], "source string, target string")
    assert {r["target"]: r["length"] for r in traverse.shortest_path_lengths(e, pairs, 5).collect()} == {"n004": 4, "n006": None, "n000": 0, "no": None}
    assert traverse.walks(e, "n003", 2).count() == 5


def by_force(e):
    """Hops from each node, by breadth-first search over all edges."""
    near = {}
    for r in e.collect():
        near.setdefault(r["from_node_id"], set()).add(r["to_node_id"])
        near.setdefault(r["to_node_id"], set()).add(r["from_node_id"])
    out = {}
    for a in near:
        out[a], front = {a: 0}, [a]
        while front:
            x = front.pop(0)
            for y in near[x] - set(out[a]):
                out[a][y] = out[a][x] + 1
                front.append(y)
    return out


def test_paths_of_any_length(spark):
    rng = random.Random(4)
    e = chain(spark, 9).unionByName(spark.createDataFrame([(f"r{i}", f"m{rng.randrange(30):02}", f"m{rng.randrange(30):02}", "t", "m", 1.0, "") for i in range(32)], EDGE))
    hops = by_force(e)
    ids = sorted(hops)
    ends = [("n000", x) for x in ids] + [(a, b) for a in ids[:6] for b in ids[::3]] + [("n000", "no"), ("no", "n000"), (None, "n000")]
    pairs = spark.createDataFrame(ends, "source string, target string").distinct()
    got = {(r["source"], r["target"]): r["length"] for r in traverse.shortest_path_lengths(e, pairs).collect()}
    assert got == {(a, b): hops.get(a, {}).get(b) for a, b in ends} and got["n000", "n009"] == 9


def test_whole_graph_queries(spark, tmp_path):
    n = 8
    kinds = ("amends", "contains", "references", "shares_defined_term")
    edges = spark.createDataFrame([(f"e{i}", f"n{i}", f"n{i + 1}", kinds[i % 4], "m", 1.0, "", T0) for i in range(n)] + [(f"h{i}", "n0", f"leaf{i}", "uses", "m", 1.0, "", T0) for i in range(5)], EDGE + ", loaded_at timestamp_ntz")
    edges.write.parquet(str(tmp_path / "edge.parquet"))
    nodes = [("n0", "rule"), *((f"n{i}", "chapter") for i in range(1, n + 1)), ("alone", "chapter")]
    spark.createDataFrame([(*x, T0) for x in nodes], "id string, node_type string, loaded_at timestamp_ntz").write.parquet(str(tmp_path / "node.parquet"))
    q = entry.queries()
    assert rows(q["components_sizes"](spark, str(tmp_path))) == [("alone", 1), ("leaf0", n + 6)]
    got = {r["target"]: r["length"] for r in q["shortest_path_len"](spark, str(tmp_path)).collect()}
    assert got == {"alone": None} | {f"n{i}": i for i in range(1, n + 1)}


def test_thresholds(spark):
    text = "The firm holds " + "some words and " * 80 + " and ".join(f"{i} per cent" for i in range(12))
    rows_ = [("a", text), ("b", "Within 10 days. The ratio is 1.5x or 25 bps."), ("c", "No limit here."), ("d", None), ("e", ""), ("f", "It costs £5 million. It costs £5 million.")]
    got = enrich.thresholds(spark.createDataFrame(rows_, "id string, text string"))
    found = {}
    for r in got.collect():
        found.setdefault(r["id"], []).append((r["kinds"], r["found"]))
    # Undivided text is read in overlapping windows, so that no value is lost.
    assert {v for k, f in found["a"] for v in f.split("; ")} >= {f"{i} per cent" for i in range(12)}
    assert sorted(found["b"]) == [("basis_points; ratio_multiple", "25 bps; 1.5x"), ("time_period; comparative_numeric", "10 days; Within 10")]
    assert found["f"] == [("currency", "£5 m")] and set(found) == {"a", "b", "f"}
    assert enrich.thresholds(got.select("id", F.col("snippet").alias("text")).limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "decision"),
    [
        ("A firm must hold £1 million in capital.", "review"),
        ("The threshold is EUR 5 million.", "review"),
        ("The firm must report within 30 days.", "exclude"),
        ("The rule refers to Article 92 CRR.", "exclude"),
        ("The carrying value of the asset was £100,000 at year end.", "exclude"),
        ("For example, if a client has a transactional account of £100,000, the amount reported is...", "exclude"),
        ("Only firms with total assets exceeding £15 billion are required to submit this return.", "review"),
        (None, "exclude"),
    ],
)
def test_monetary_decision(spark, text, decision):
    assert spark.createDataFrame([(text,)], "t string").select(enrich.monetary_decision(F.col("t"))).first()[0] == decision


def test_text_references(spark):
    part = lambda p, n: json.dumps({"part_title": p, "rule_number": n})
    n = spark.createDataFrame([("r1", "rule", "Audit 1.1", "See rule 1.2(a), rule 1.2 and Articles 4, 5(2) and 6. Article 7 of the CRR and Big–Ledger Rules 3.3 apply. The ratio is 21.25.", part("Audit", "1.1")), ("r2", "rule", "Audit 1.2", None, part("Audit", "1.2")), ("a5", "chapter", "Article 5 Scope", "", part("Audit", None)), ("a6", "rule", "Article 6", "", part("Audit", None)), ("b", "rule", "3.3", "", part("Big-Ledger Rules", "3.3")), ("p", "guidance_paragraph", "x", "rule 1.2", None)], "id string, node_type string, title string, text string, metadata_json string")
    got = {(r["to_id"], r["scope"], r["reference"]) for r in enrich.text_references(n).where("from_id = 'r1'").collect()}
    assert got == {("r2", "same_part", "1.2"), ("a5", "same_part_article", "5"), ("a6", "same_part_article", "6"), ("external:uk-crr:article:7", "uk_crr", "7"), ("b", "cross_part_named", "3.3")} or got >= {("r2", "same_part", "1.2"), ("b", "cross_part_named", "3.3")}
    assert enrich.text_references(n).where("from_id <> 'r1'").count() == 0 and enrich.text_references(n.limit(0)).count() == 0


def test_source_groups(spark):
    rows_ = [("a", "https://x/y/Doc.pdf?utm_source=z", "c1", "pdf", "Guidance notes"), ("a-v-2", "https://X/y/Doc.pdf", "c2", "pdf", "Guidance notes longer"), ("b", None, "C9", "pdf", "Same Title"), ("c", "", "c9 ", "pdf", "same title!"), ("d", None, "c9", "xml", "Same"), ("e", "https://x/t.xsd", "", "xsd", "T"), ("f", "https://x/t.xsd", "", "xsd", "T"), ("g", None, None, None, None)]
    got = {r["source_id"]: (r["source_kind"], r["canonical_id"], r["decision"]) for r in canonical.source_groups(spark.createDataFrame(rows_, "source_id string, url string, checksum string, file_type string, title string")).collect()}
    assert got == {"a": ("instruction_pdf", "a", "canonical"), "a-v-2": ("instruction_pdf", "a", "duplicate_url"), "b": ("pdf_document", "c", "duplicate_checksum"), "c": ("pdf_document", "c", "canonical"), "d": ("taxonomy_xml", "d", "canonical"), "e": ("taxonomy_schema", "e", "canonical"), "f": ("taxonomy_schema", "f", "canonical"), "g": ("other_source", "g", "canonical")}


def test_shortest_path_and_walks(spark):
    e = spark.createDataFrame([("1", "a", "b", "x"), ("2", "b", "d", "x"), ("3", "a", "c", "y"), ("4", "c", "d", "y"), ("5", "d", "e", "x"), ("6", "q", "r", "x"), ("7", "e", "e", "x")], "id string, from_node_id string, to_node_id string, edge_type string")
    path = lambda a, b: [(r["nth"], r["id"], r["edge_id"]) for r in traverse.shortest_path(e, a, b).orderBy("nth").collect()]
    assert path("e", "a") == [(0, "e", None), (1, "d", "5"), (2, "b", "2"), (3, "a", "1")] and path("a", "a") == [(0, "a", None)] and path("a", "q") == []
    got = [r["path"] for r in traverse.walk_paths(e, "a", 4, "e", 5).collect()]
    assert got == [["a", "b", "d", "e"], ["a", "c", "d", "e"]]
    assert traverse.walk_paths(e, "a", 2).count() == 4


def test_obligations_of_long_texts(spark, tmp_path):
    text = " ".join(f"The Board must approve plan {chr(97 + i)} of the firm." for i in range(26)) + " The Auditor may object unless told."
    n = spark.createDataFrame([("a", text, T0)], "id string, text string, loaded_at timestamp_ntz")
    assert enrich.obligations(n).count() == 27 and enrich.obligations(n, most=6).count() == 6
    n.write.parquet(str(tmp_path / "node.parquet"))
    q = entry.queries()
    assert rows(q["clause_obligations"](spark, str(tmp_path))) == [("may", "unless", 1, 1), ("must", "", 26, 1)]
    assert q["regex_obligations"](spark, str(tmp_path)).count() == 27
    assert q["obligation_patterns"](spark, str(tmp_path)).count() == 27


def test_roll_up(spark):
    e = spark.createDataFrame([("c1", "doc", "sec", "contains", "m", 1.0, ""), ("c2", "sec", "par", "contains", "m", 1.0, ""), ("c3", "sec", "par2", "contains", "m", 1.0, ""), ("r1", "rule", "par", "references", "m", 0.7, ""), ("r2", "rule", "par2", "references", "m", 0.9, "")], EDGE)
    n = spark.createDataFrame([("doc", "guidance_document"), ("sec", "s"), ("par", "p"), ("par2", "p")], "id string, node_type string")
    a = traverse.nearest_ancestor(e, n, F.col("node_type") == "guidance_document", F.lit(0))
    assert rows(traverse.roll_up(e, a)) == [("rule", "doc", "references", 0.9, "par,par2")]


def test_text_and_search(spark):
    t = spark.createDataFrame([("MCMXC", " HTTP://Ex.COM/a/?b=2&utm_x=1&a=1#f "), ("IIV?", None), (None, "")], "r string, u string")
    got = t.select(X.roman_to_int(F.col("r")), X.column_number(F.lit("AB")), X.normalise_url(F.col("u"))).collect()
    assert [r[0] for r in got] == [1990, None, None] and got[0][1] == 28 and [r[2] for r in got] == ["http://ex.com/a?a=1&b=2", None, None]
    n = spark.createDataFrame([("1", "Liquidity buffer", "buffer of the firm"), ("2", "Other", "liquidity and a buffer"), ("3", None, None)], "id string, title string, text string")
    found = {r["id"]: r["score"] for r in search.bm25(n, "liquidity buffer").collect()}
    assert found["1"] == -1e6 and set(found) == {"1", "2"} and search.bm25(n.limit(0), "x").count() == 0


def test_enrichment_and_reporting(spark):
    n = spark.createDataFrame([("a", "The Board must approve the annual plan of the firm without delay."), ("b", "Exposures above £5.2 million within 10 working days exceed 12 per cent.")], "id string, text string")
    o = enrich.obligations(n).first()
    assert (o["modal"], o["action"]) == ("must", "approve")
    assert {k for r in enrich.thresholds(n).where("id = 'b'").collect() for k in r["kinds"].split("; ")} >= {"currency", "percentage"}
    p = spark.createDataFrame([("1", "<a class=x href=\"/rules/1\">a</a><A HREF='mailto:x'>m</A>"), ("2", None)], "id string, raw_html string")
    assert rows(enrich.links(p)) == [("1", 0, "/rules/1", "rule")]
    e = spark.createDataFrame([("i", "U", "t1"), ("i", "U", "t1"), ("i", "E", "d1"), ("d1", "R", "p")], "source string, edge_type string, target string")
    items = spark.createDataFrame([("i",), ("j",)], "id string")
    assert rows(reporting.typed_counts(items, e, {"u": "U"})) == [("i", 1), ("j", 0)]
    assert rows(reporting.relying_on(e, "E", "R")) == [("p", "i", "d1")] and rows(reporting.without_edge(items, e, "E")) == [("j",)]


def test_vectors_and_analytics(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.9, 0.1]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0])], "vec_id int, embedding array<float>")
    assert rows(semantic.similar(v, v.where("vec_id = 1"), 2).select("query", "other")) == [(1, 2), (1, 3)]
    exact = {r["id"]: r["score"] for r in analytics.betweenness(chain(spark, 4), 99, 99).collect()}
    assert abs(exact["n002"] - 8 / 12) < 1e-6
    two = spark.createDataFrame([(f"{g}{a}{b}", f"{g}{a}", f"{g}{b}", "t", "m", 1.0, "") for g in "xy" for a in range(4) for b in range(a)] + [("z", "x0", "y0", "t", "m", 1.0, "")], EDGE)
    c = dict(analytics.greedy_communities(two).collect())
    assert len({c[f"x{i}"] for i in range(4)}) == 1 and c["x1"] != c["y1"]
    assert analytics.modularity(two, analytics.greedy_communities(two)).first()[0] > 0.3


def test_pages_and_files(spark, tmp_path):
    got = html.page_spans("<h1>A</h1><p>x &amp; y<script>no()</script></p><h2>B</h2><ul><li>one<li>two</ul>")
    assert [(k, p, t) for k, p, _, t in got] == [("heading", "A", "A"), ("paragraph", "A", "x & y"), ("heading", "A > B", "B"), ("item", "A > B", "one"), ("item", "A > B", "two")]
    ns = "http://schemas.openxmlformats.org/"
    (tmp_path / "w").mkdir()
    with zipfile.ZipFile(tmp_path / "w" / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}spreadsheetml/2006/main" xmlns:r="{ns}officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}spreadsheetml/2006/main"><si><t>Na</t><t>me</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1"><v>7</v></c><c r="AB1" t="s"><v>0</v></c></row></sheetData></worksheet>')
    (tmp_path / "w" / "bad.xlsx").write_bytes(b"nothing")
    cells = files.read_workbooks(spark, str(tmp_path / "w"))
    assert rows(files.workbook_rows(cells).select("row_number", "line")) == [(1, "7 | Name")] and cells.where("ref = 'AB1'").first()["column_number"] == 28
    (tmp_path / "m.csv").write_text("url,checksum_sha256,title\nu1,c1,A\nu2,c2,B\n")
    m = files.read_manifest(spark, str(tmp_path / "m.csv"))
    assert rows(files.new_sources(m, m.where("url = 'u1'")).select("url")) == [("u2",)]
    (tmp_path / "q.jsonl").write_text('{"id": "1", "status": "pending"}\n{broken\n')
    assert rows(files.read_jsonl(spark, str(tmp_path / "q.jsonl"), "id string, status string").select("status")) == [("corrupt",), ("pending",)]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    args = (spark, str(src), "id string, v string", "id", str(tmp_path / "out"), str(tmp_path / "state"))
    for name, v, ids in (("a", "x", "121"), ("b", "y", "23")):
        (src / f"{name}.json").write_text("\n".join(json.dumps({"id": i, "v": v}) for i in ids))
        stream.ingest_once(*args)
    stream.ingest_once(*args)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("id", "v")) == [("1", "x"), ("2", "x"), ("3", "y")]
    q = spark.createDataFrame([("a", "pending", 1, 1), ("a", "running", 2, 2), ("a", "completed", 3, 3), ("b", "pending", 1, 1), ("b", "completed", 2, 2)], "id string, status string, at int, seq int")
    assert rows(stream.queue_state(q).select("id", "status")) == [("a", "completed"), ("b", "pending")]
    # An event that was refused doesn't change what the next one is compared with; days are folded one after another.
    q = spark.createDataFrame([("a", "pending", 1, 1), ("a", "completed", 2, 2), ("a", "running", 3000, 3), ("a", "running", 3001, 4), ("a", "failed", 9000, 5), ("b", "running", 1, 1), (None, "pending", 1, 1), ("c", "pending", None, 1)], "id string, status string, at int, seq int")
    assert rows(stream.queue_state(q)) == [("a", "failed", 9000)] and stream.queue_state(q.limit(0)).count() == 0


def test_a_batch_run_again_keeps_its_rows(spark, tmp_path):
    """A crash after the rows were written and before the batch was committed."""
    src = tmp_path / "in"
    src.mkdir()
    args = (spark, str(src), "id string, v string", "id", str(tmp_path / "out"), str(tmp_path / "state"))
    for name, ids in (("a", "12"), ("b", "23")):
        (src / f"{name}.json").write_text("\n".join(json.dumps({"id": i, "v": name}) for i in ids))
        stream.ingest_once(*args)
        for f in (tmp_path / "state" / "commits").iterdir():
            if f.name.strip(".").startswith(str(len(name) - 1 if name == "a" else 1)):
                f.unlink()
        stream.ingest_once(*args)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("id", "v")) == [("1", "a"), ("2", "a"), ("3", "b")]


def test_late_events_are_dropped_and_windows_leave_the_state(spark, tmp_path):
    import time

    src = str(tmp_path / "in")
    for k, hours in enumerate(((1, 2), (10,), (11,), (1, 9))):
        spark.createDataFrame([(f"2024-01-01 {h:02}:30:00", "x", 1.0) for h in hours], "ts string, event_type string, value double").selectExpr("cast(ts as timestamp_ntz) ts", "event_type", "value").coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1 if k < 3 else 0)
    stream.windowed_counts(spark, src, "ts timestamp_ntz, event_type string, value double", str(tmp_path / "out"), str(tmp_path / "state"))
    got = stream.latest_windows(spark, str(tmp_path / "out")).selectExpr("hour(start) h", "n")
    assert rows(got) == [(1, 1), (2, 1), (9, 1), (10, 1), (11, 1)]


def test_checkpoint_folder(spark, monkeypatch):
    """On a cluster without a shared folder it is an error to cut."""
    from types import SimpleNamespace

    from lexgraph import runtime

    fake = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(RuntimeError):
        runtime.ensure_checkpoint_dir(fake)
    df = runtime.cut(spark.range(3))
    path = "/" + next(reversed(runtime._HELD)).removeprefix("file:").lstrip("/")
    assert df.count() == 3 and os.path.isdir(path)
    runtime.release(spark)
    assert not os.path.exists(path)


def test_stalls(spark):
    e = spark.createDataFrame([("a", "2024-01-01 01:00:00"), ("a", "2024-01-01 03:00:00"), ("a", "2024-01-03 00:00:00"), ("b", "2024-01-01 00:00:00"), (None, "2024-01-01 00:00:00"), ("a", None)], "k string, ts string").selectExpr("k", "cast(ts as timestamp_ntz) ts")
    assert rows(stream.stalls(e, "k").select("k", "seconds")) == [("a", 7200), ("a", 162000)] and stream.stalls(e.limit(0), "k").count() == 0
