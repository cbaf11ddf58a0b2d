"""The subpackage's operators: brute force, exact round trips, invariants, and awkward inputs."""

import json
import random
import re
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexgraph import runtime
from lexgraph.llm import bpe, knn, markup, neardup, packing, scanned, sentences, split, survivor
from lexgraph.runtime import tokenizer_path

LONG = "A firm must keep each record of the ledger. " * 4000


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(tokenizer_path())


def texts(n=400):
    rng = random.Random(3)
    parts = ["<|endoftext|>", "a", " ", "  ", "\n", "é", "ß", "²", "½", "٣", "漢字", "🙂", "'s", "_", "\x1c", "\xa0", "ก", "the", "ing", "12", "-", "…"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["a" * 3000, " " * 200]


def test_bpe_equals_the_public_library(encoder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    want = [x.ids for x in t.encode_batch(texts(), add_special_tokens=False)]
    assert [list(encoder.ids(x)) for x in texts()] == want


def test_bpe_round_trip_and_state_machine(encoder):
    for x in texts():
        assert "".join(bpe.decode_stream(encoder.ids(x), encoder.fst.bytes)) == x
    assert "".join(bpe.decode_stream([0, 1, 2], {0: b"\xe2\x82", 1: b"a", 2: b"\xf0\x9f"})) == b"\xe2\x82a\xf0\x9f".decode("utf-8", "replace")


def test_bpe_forgets_and_stays_the_same(encoder, monkeypatch):
    for name in ("MOST_TRANSITIONS", "MOST_PIECES", "MOST_FITS"):
        monkeypatch.setattr(bpe, name, 50)
    forgetful = bpe.Encoder(tokenizer_path())
    assert [list(forgetful.ids(x)) for x in texts(60)] == [list(encoder.ids(x)) for x in texts(60)] and len(forgetful.fst.fits) < 100


def test_bpe_column(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, LONG, "x"), (3, LONG, "x")], "doc_id long, text string, IDS string")
    got = bpe.encode(df).collect()
    assert [len(r["ids"]) for r in got[:2]] == [0, 0] and got[2]["ids"] == got[3]["ids"] and len(got[2]["ids"]) > 30000
    assert bpe.encode(df.limit(0)).count() == 0 and bpe.count_tokens(df).where("doc_id = 1").first()["n_tokens"] == 0


def test_split(spark):
    rng = random.Random(1)
    for t in (LONG, "x" * 9000, "漢字。" * 2000, " ".join("word%d" % rng.randint(0, 50) for _ in range(3000)), "p one.\n\np two.\n\n" * 300):
        p = split.split_text(t)
        assert p[0][0] == 0 and p[-1][1] == len(t) and all(0 < b - a <= 1800 for a, b in p)
        assert all(x[0] < y[0] <= x[1] and x[1] - y[0] <= 190 for x, y in zip(p, p[1:]))
    df = spark.createDataFrame([("a", LONG, 1), ("a", LONG, 2), ("b", None, 1), ("c", "", 1), (None, LONG, 1)], "id string, text string, loaded_at int").withColumn("piece", F.lit(0)).withColumn("item_id", F.lit(0))
    got = split.split_oversized(df, "node", "id", "text", "loaded_at")
    assert {r[0] for r in got.select("item_id").distinct().collect()} == {"a", None}
    assert got.where("item_id = 'a' and piece_no = 1").count() == 1 and split.split_oversized(df.limit(0), "n", "id", "text").count() == 0


def test_split_of_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, LONG, 1)] * 3 + [("a", LONG, 1), ("a", LONG + "x", 1)], "id string, text string, loaded_at int")
    got = split.split_oversized(df, "node", "id", "text", "loaded_at").where("piece_no = 1").groupBy("item_id").count()
    assert {r[0]: r[1] for r in got.collect()} == {None: 3, "a": 1}


def test_split_cuts_at_the_change_of_topic():
    a = "The custodian reconciles ledger entries against custody statements daily. " * 14
    b = "Penguins hatch eggs under antarctic ice while whales migrate northward. " * 14
    assert split.split_text(a + b)[0][1] == len(a)


def pairs_by_force(rows):
    words = {i: set(re.findall(r"[^\W_]+", f"{t or ''} {x}".lower())) for i, t, x in rows if i and x and len(x) <= 1800 and len(x.split()) >= 30}
    return {(a, b) for a, b in combinations(sorted(words), 2) if 10 * len(words[a] & words[b]) >= 7 * len(words[a] | words[b])}


def near_duplicate_rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(160)]
    rows = []
    for f in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 70))]
        for k in range(5):
            copy = list(base)
            for _ in range(k * 3):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((f"n{f:02}{k}", "title", " ".join(copy)))
    # Few different words; a family of sets that differ in one rare word; one of so few words that they aren't similar.
    rows += [(f"r{k}", None, " ".join([f"w{k % 3}", "w1"] * 20)) for k in range(6)]
    rows += [(f"f{k:02}", "t", " ".join([f"w{i}" for i in range(35)] + [f"rare{k}"])) for k in range(12)]
    rows += [(f"g{k:02}", None, " ".join(["w0 w1 w2"] * 12 + [f"seldom{k}"])) for k in range(6)]
    return rows + [("x1", None, rows[0][2]), ("x2", "t", None), ("x3", "t", ""), (None, "t", rows[0][2]), ("x4", "t", "w1 " * 900), ("x5", "t", "short")]


@pytest.mark.parametrize("long", [neardup.LONG, 3, 40])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, long):
    """With lists of single words only, of pairs of words almost only, and of both; long ones in bands and chunks."""
    if long < neardup.LONG:
        monkeypatch.setattr(neardup, "CHUNK", 16)
    rows = near_duplicate_rows()
    df = spark.createDataFrame([(*r, 1, "c") for r in rows + rows[:3]], "id string, title string, text string, loaded_at int, rep string")
    want = pairs_by_force(rows)
    got = [tuple(r) for r in neardup.near_duplicate_pairs(df, long=long).collect()]
    assert set(got) == want and len(got) == len(want) > 20
    links = {r["id"]: r["n_links"] for r in neardup.near_duplicate_classes(df, long=long).collect()}
    assert {i: n for i, n in links.items() if n} == {i: sum(i in p for p in want) for i in {x for p in want for x in p}}
    assert neardup.near_duplicate_pairs(df.limit(0)).count() == 0 and neardup.near_duplicate_classes(df.limit(0)).count() == 0


def test_near_duplicates_in_rounds_free_their_disk(spark, monkeypatch):
    """Blocks and lists in several rounds find all pairs; what was shuffled and the tables of words are gone afterwards."""
    for name, value in (("CHUNK", 16), ("BLOCK", 40), ("LEAST_ROUND", 200), ("ROUND_ROWS", 2), ("COLUMNS", 64)):
        monkeypatch.setattr(neardup, name, value)
    rows = near_duplicate_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, title string, text string, at int")
    files = lambda: str(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",")).count("shuffle_")
    for long in (0, 1000):
        before, held = files(), set(runtime._HELD)
        found = neardup.near_duplicate_sets(df, long)
        until = time.time() + 10
        while files() > before and time.time() < until:
            time.sleep(0.2)
        assert files() <= before and len(set(runtime._HELD) - held) == 3
        rep = {r["id"]: r["rep"] for r in found.members.collect()}
        links = {tuple(r) for r in found.links.collect()}
        want = {tuple(sorted((rep[a], rep[b]))) for a, b in pairs_by_force(rows) if rep[a] != rep[b]}
        families = {r["rep"]: r["leader"] for r in found.families().collect()}
        assert {p for p in want if families.get(p[0], 0) != families.get(p[1], 1)} <= links <= want


def test_near_duplicates_of_many_copies(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(f"c{i:03}", "", text) for i in range(80)] + [("d", "", text + " other")], "id string, title string, text string")
    assert neardup.near_duplicate_pairs(df, loaded=None).count() == 81 * 80 // 2
    got = {r["id"]: tuple(r)[1:] for r in neardup.near_duplicate_classes(df, loaded=None).collect()}
    assert len(got) == 81 and got["c079"] == ("c000", 80, 80) and got["d"] == ("d", 1, 80)


def test_near_duplicates_of_equal_sets_and_different_texts(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    rows = [(f"c{i:02}", "", " ".join(words[i:] + words[:i])) for i in range(55)] + [("d", "", " ".join([*words, "other"]))] + [(f"x{i:02}", "T", " ".join(words)) for i in range(55)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, title string, text string, loaded_at int")
    df.write.parquet(str(tmp_path / "node.parquet"))
    got = {tuple(r) for r in entry.queries()["p4_found"](spark, str(tmp_path)).collect()}
    assert got == pairs_by_force(rows) and len(got) == 111 * 110 // 2


def test_the_latest_delivery_counts_even_if_it_takes_no_part(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([("a", "", text, 1), ("b", "", text, 1), ("b", "", "short", 2), ("c", "", text, 2), ("c", "", None, 1)], "id string, title string, text string, loaded_at int")
    assert [tuple(r) for r in neardup.near_duplicate_pairs(df).collect()] == [("a", "c")]


def test_nearest_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1200, 16))
    x[600:900] = x[:300] + 0.1 * rng.standard_normal((300, 16))
    rows = [(f"n{i:04}", "m", json.dumps(list(v)), "2024") for i, v in enumerate(x)]
    bad = [("b1", "m", None, "1"), ("b2", "m", "[1, 2]", "1"), ("b3", "m", "[]", "1"), ("b4", "m", json.dumps([0.0] * 16), "1"), ("b5", "m", "[NaN" + ", 1" * 15 + "]", "1"), ("b6", None, rows[0][2], "1"), (None, "m", rows[0][2], "1"), ("n0001", "m", rows[5][2], "1999")]
    df = spark.createDataFrame(rows + bad + rows[:2], "node_id string, model_name string, vector_json string, created_at string").withColumn("cls", F.lit(1))
    got = {}
    for r in knn.nearest(knn.usable_vectors(df)).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    want = {f"n{i:04}": {f"n{j:04}" for j in np.argsort(-s[i])[:5]} for i in range(len(x))}
    assert set(got) == set(want) and sum(len(got[k] & want[k]) for k in want) / (5 * len(want)) >= 0.9
    pairs = {tuple(r) for r in knn.similar_pairs(knn.nearest(knn.usable_vectors(df), least=0.9), 0.9).collect()}
    true = {tuple(sorted((a, b))) for a in want for b in want[a] if s[int(a[1:]), int(b[1:])] >= 0.9}
    assert len(pairs & true) / len(true) >= 0.99 and pairs <= true
    assert knn.nearest(knn.usable_vectors(df.limit(0))).count() == 0


def test_nearest_vectors_in_parted_cells(spark):
    """Few cells and small blocks, so that cells are parted and what remains large has several blocks."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 24))
    x = np.repeat(centres, 40, axis=0) + 0.35 * rng.standard_normal((2400, 24))
    df = spark.createDataFrame([(f"{i:04x}", "m", json.dumps(list(v)), "2024") for i, v in enumerate(x)], "node_id string, model_name string, vector_json string, created_at string")
    vectors = knn.usable_vectors(df)
    r = knn.recall(vectors, knn.nearest(vectors, most_cells=8, per_cell=40, block=100), F.pmod(F.conv("id", 16, 10).cast("int"), F.lit(10)) == 0).first()
    assert r["n_queries"] == 240 and r["n_true"] == 1200 and r["recall"] >= 0.9


def test_walking_outward_counts_what_windows_hold():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 32))
    x[250:] = x[:250] + 0.2 * rng.standard_normal((250, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j, c = knn.Block(x).search(x[:40], 6, -2.0)
    for k in range(40):
        assert set(np.argsort(-(x @ x[k]))[:3]) <= set(j[i == k]) and (i == k).sum() == 6
    i, j, c = knn.Block(x).search(x[:40], 6, 0.9)
    assert sorted(zip(i, j)) == [(k, m) for k in range(40) for m in np.flatnonzero(x @ x[k] >= 0.9)]


def test_equal_vectors_go_by_id(spark):
    df = spark.createDataFrame([(f"n{i:02}", "m", "[1, 0]", "x") for i in range(40)], "node_id string, model_name string, vector_json string, created_at string")
    got = knn.nearest(knn.usable_vectors(df))
    assert [r[0] for r in got.where("id = 'n39'").orderBy("nth").select("neighbour").collect()] == [f"n{i:02}" for i in range(5)]
    assert [r[0] for r in got.where("id = 'n00'").orderBy("nth").select("neighbour").collect()] == [f"n{i:02}" for i in range(1, 6)]


def copies(spark, rows):
    return spark.createDataFrame(rows, "group_id long, node_id string, trust_rank int, at timestamp_ntz, code string, kind string, team string")


def test_survivor(spark):
    from datetime import datetime as D

    df = copies(spark, [(1, "a", 2, D(2024, 1, 1), "c1", None, "t1"), (1, "b", 1, None, None, "k2", None), (1, "c", 1, D(2024, 1, 1), "c3", None, None), (2, "d", None, None, None, None, None), (2, "e", None, None, None, None, None)])
    alone = {(r["group_id"], r["field_name"]): r["node_id"] for r in survivor.best_bundles(df, {"code": ["code"], "kind": ["kind"], "team": ["team"]}).collect()}
    assert alone == {(1, "code"): "c", (1, "kind"): "b", (1, "team"): "a"}
    assert dict(survivor.surviving_copy(df, ["code", "kind", "team"]).collect()) == {1: "a", 2: "d"}
    assert survivor.best_bundles(df.limit(0), {"code": ["code"]}).count() == 0


def test_survivor_keeps_dependencies(spark):
    # The best kind is seen with another code only; both must come from values seen together.
    df = copies(spark, [(1, "a", 1, None, "c1", "k1", None), (1, "b", 2, None, "c2", "k2", None)])
    split_best = copies(spark, [(1, "a", 1, None, "c1", None, None), (1, "a2", 3, None, "c1", "k1", None), (1, "b", 2, None, "c2", "k2", None)])
    for d, want in ((df, ("c1", "k1")), (split_best, ("c1", "k1"))):
        got = {r["field_name"]: r["value"] for r in survivor.best_bundles(d, {"code": ["code"], "kind": ["kind"]}, [survivor.Dependency("code", "kind")]).collect()}
        assert (got["code"], got["kind"]) == want


def survivor_by_force(rows, deps):
    """The cheapest consistent choice of each group: code and kind, with kind depending on code if deps."""
    from datetime import datetime as D
    from itertools import product

    out = {}
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        pairs = {(r[4], r[5]) for r in mine if r[4] and r[5]}
        options = [[(2**31 if r[2] is None else r[2], -(r[3] - D(1, 1, 1)).total_seconds() if r[3] else 0, r[1], r[k]) for r in mine if r[k]] or [None] for k in (4, 5)]
        best = None
        for a, b in product(*options):
            if deps and a and b and any(x == a[3] for x, _ in pairs) and (a[3], b[3]) not in pairs:
                continue
            have = [x for x in (a, b) if x]
            key = (sum(x[0] for x in have), sum(x[1] for x in have), [x[2] for x in have])
            if have and (best is None or key < best[0]):
                best = (key, {(g, f): x[3] for f, x in (("code", a), ("kind", b)) if x})
        out |= best[1] if best else {}
    return out


def test_survivor_equals_brute_force_in_any_number_of_rounds(spark):
    from datetime import datetime as D

    rng = random.Random(8)
    rows = [(g, f"n{g:02}{i:02}", rng.choice([1, 2, 10_000, 20_000, None]), rng.choice([None, D(2024, 1, 1, 10, 0, 5), D(2024, 1, 1, 10, 0, 50), D(2023, 5, 5)]), rng.choice([None, "c1", "c2", "c3"]), rng.choice([None, "k1", "k2", "k3", "k4"]), None) for g in range(40) for i in range(rng.randint(1, 9))]
    for deps in ([], [survivor.Dependency("code", "kind")]):
        for first in (1, 64):
            got = survivor.best_bundles(copies(spark, rows), {"code": ["code"], "kind": ["kind"]}, deps, first=first).collect()
            assert {(r["group_id"], r["field_name"]): r["value"] for r in got} == survivor_by_force(rows, deps)


def test_survivor_ranks_and_times_in_full(spark):
    from datetime import datetime as D

    df = copies(spark, [(1, "a", 20_000, None, "c1", None, None), (1, "b", 10_000, None, "c2", None, None), (2, "c", 1, D(2024, 1, 1, 10, 0, 5), "c1", None, None), (2, "d", 1, D(2024, 1, 1, 10, 0, 50), "c2", None, None), (3, "e", None, D(2024, 1, 1), "c1", None, None), (3, "f", 2**31 - 1, None, "c2", None, None)])
    assert {r["group_id"]: r["node_id"] for r in survivor.best_bundles(df, {"code": ["code"]}).collect()} == {1: "b", 2: "d", 3: "f"}
    assert dict(survivor.surviving_copy(df, ["code", "kind"]).collect()) == {1: "b", 2: "d", 3: "f"}


def test_survivor_where_no_whole_is_consistent(spark):
    # Two determinants of one field that were never seen with the same value of it: one bundle stays empty.
    df = copies(spark, [(1, "a", 1, None, "c1", "k1", None), (1, "b", 2, None, None, "k2", "t1")])
    deps = [survivor.Dependency("code", "kind"), survivor.Dependency("team", "kind")]
    got = {r["field_name"]: r["value"] for r in survivor.best_bundles(df, {"code": ["code"], "kind": ["kind"], "team": ["team"]}, deps).collect()}
    assert got == {"code": "c1", "kind": "k1"}


def test_survivor_values_and_times(spark):
    values = ["x", " N/A ", "(unknown)", "—", "to be confirmed", "T.B.C.", None, "", "0", "page 3"]
    times = ["2024-06-01", "01/02/2024", "3 May 2024", "2024-06-01T10:30:00.250Z", "2024-06-01T10:30:00+02:00", "soon", None]
    df = spark.createDataFrame([(v,) for v in values], "v string").select(survivor.real_value(F.col("v")))
    assert [r[0] for r in df.collect()] == ["x", None, None, None, None, None, None, None, "0", "page 3"]
    got = spark.createDataFrame([(v,) for v in times], "v string").select(survivor.moment(F.col("v")).cast("string"))
    assert [r[0] for r in got.collect()] == ["2024-06-01 00:00:00", "2024-02-01 00:00:00", "2024-05-03 00:00:00", "2024-06-01 10:30:00.25", "2024-06-01 08:30:00", None, None]


def test_scanned(spark):
    clean = ["The custodian must report the quarterly ledger of the firm and value each forward-looking transfer without delay."] * 60
    bad = "The custo-\ndian must rep0rt the quarterly l e d g e r of the\n\fCONSOLIDATED AUDIT TEXT\nfirm and\n- 12 -\nvalue each tranfer"
    own = "The custodian must value each forward-\nlooking transfer of the firm."
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*clean, bad, own, None, "", LONG])], "id long, text string").withColumn("traces", F.lit("x"))
    got = {r["id"]: r for r in scanned.repair_scanned(df, scanned.corpus_counts(df)).collect()}
    assert got[60]["traces"] == 5 and got[60]["repaired"].startswith("The custodian must report the quarterly ledger of the firm and value each")
    assert all(got[i]["traces"] == 0 and got[i]["repaired"] == got[i]["text"] for i in (0, 61, 62, 63, 64))
    assert scanned.repair_scanned(df.limit(0), scanned.corpus_counts(df.limit(0))).count() == 0


def test_scanned_words_cut_inside_a_misreading(spark):
    clean = ["The custodian must report irrespective of the quarterly ledger that exceeds 290 basis points of the firm."] * 60
    bad = ["The custodian must report irre5pec-\ntive of the quarterly ledger that exceecls 290 basis points of the firm."]
    df = spark.createDataFrame([(t,) for t in clean + bad], "text string")
    got = scanned.repair_scanned(df, scanned.corpus_counts(df)).where("traces > 0").collect()
    assert [(r["traces"], r["repaired"]) for r in got] == [(3, clean[0])]


def test_running_lines_are_verified_by_key(spark, monkeypatch):
    """With a filter that lets everything through, only lines that recur in different surroundings go."""
    monkeypatch.setattr(scanned, "BITS", 8)
    page = "The custodian of record {} must report the quarterly ledger of\n{}\nthe firm to the board in due course."
    rows = [page.format(i, "Running Header Text") for i in range(5)] + [page.format(9, "Other Heading Here")]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    got = {r["id"]: r["repaired"] for r in scanned.repair_scanned(df, scanned.corpus_counts(df)).collect()}
    assert all("Header" not in got[i] for i in range(5)) and got[5] == rows[5]


@pytest.mark.parametrize(
    ("raw", "found", "text"),
    [
        ("<h1>A</h1><ul><li>x<li>y</ul><pre>a &lt; b</pre>", {"html"}, "A\n\n- x\n- y\n\n    a < b"),
        ("&lt;p&gt;Hello &amp;amp; you&lt;/p&gt;", {"html"}, "Hello & you"),
        ("# T\n\nsome **bold** and `code`\n\n```\nx = 1\n```", {"markdown"}, "T\n\nsome bold and code\n\n    x = 1"),
        ("== T ==\n\n''it'' and [[Page|word]]{{cite}}", {"wiki"}, "T\n\nit and word"),
        ("\\section{T}\nGiven \\emph{x}\\footnote{n}:\n\\[ a_1 \\]", {"latex"}, "T\n\nGiven x:\n\na_1"),
        ("&amp;amp;amp;amp;lt;p&amp;amp;amp;amp;gt;hi&amp;amp;amp;amp;lt;/p&amp;amp;amp;amp;gt;", {"html"}, "hi"),
        ("\\emph{" * 12 + "deep" + "}" * 12, {"latex"}, "deep"),
        ("So $" + "a + " * 120 + "x_1$ holds.", {"latex"}, "So $" + "a + " * 120 + "x_1$ holds."),
        ("Seen ``by the firm's " + "very " * 120 + "board'' today.", {"latex"}, "Seen “by the firm's " + "very " * 120 + "board” today."),
        ("\\section{A \\emph{b}}\nText\\footnote{see \\emph{x} {y}} goes \\newthing{on}.", {"latex"}, "A b\n\nText goes on."),
        ("<p>One of the two.\n\n\\section{Next}\n\nIt is\\cite{a} so.", {"html", "latex"}, "One of the two.\n\nNext\n\nIt is so."),
        ("<p>One of the two.\n\n== Next ==\n\n* ''it''", {"html", "wiki"}, "One of the two.\n\nNext\n\n- it"),
        ("<rule-text>One of <term>the</term> two</rule-text> if a <n> b.", {"html"}, "One of the two if a <n> b."),
        ("<div>x<table><tr><td>1</td></tr></table>\nA&nbsp; b &amp;amp; c</div>", {"html"}, "x\n\n1\n\nA b & c"),
        ("Files in C:\\returns\\q1 hold {r031} of map<k, v> and List<String>.", set(), None),
        ("A charge of $5 million or $8 million; a|b -- x < 4 and y > 2, a == b, see [3] in C:\\returns\\q1 & so #52, 3^2.", set(), None),
    ],
)
def test_markup(raw, found, text):
    d = markup.Document(raw)
    assert d.found == found and d.text() == (raw if text is None else text)


CONTENT = "The firm must keep a record of each of the transfers that it has made in the course of the year and show it to the board when it asks for it. It may not be kept by any other firm unless the board has agreed to that in writing."


def test_markup_drops_boilerplate_without_links():
    menu = "Cookies Privacy Login Sitemap Careers Newsroom Accessibility Contact Imprint Subscribe " * 6
    german = "Das Institut muss die Meldung an die Aufsicht bis zum Ende des Monats abgeben und dabei auch den Wert der Sicherheiten angeben, die es im Laufe des Jahres von den Kunden erhalten hat. Sie ist von einem Prüfer zu unterschreiben."
    for body in (CONTENT, german):
        page = f"<h1>Rule</h1><p>{menu}</p><p>Home</p><p>{menu}</p><p>{body}</p><p>In short.</p><p>{menu}</p>"
        assert markup.Document(page).text() == f"Rule\n\n{body}\n\nIn short."
    # Tables in plain text stay, and so does all of a page in a language whose stop words aren't known.
    plain = "aggregation   5591   case HX-7207\ndataset   4644   case HX-1920\noutflow   9488   row 36720"
    assert "HX-1920" in markup.Document(f"<p>{CONTENT}</p>\n\n{plain}\n\n<p>{CONTENT}</p>").text()
    foreign = "Przedsiębiorstwo powinno przechowywać ewidencję każdego transferu dokonanego podczas roku sprawozdawczego " * 3
    assert "sprawozdawczego" in markup.Document(f"<p>{foreign}</p>").text()


def test_markup_is_linear():
    import time

    began = time.time()
    for raw in ("\\emph{" * 20000, "{" * 50000, "$" + "a_1 " * 50000, "<p>" * 20000, "``" * 20000, "&amp;" * 20000 + "lt;p", "<x>" * 20000 + "</x>" * 20000):
        markup.Document(raw).text()
    assert time.time() - began < 20


def test_markup_column(spark):
    df = spark.createDataFrame([("1", None, 1), ("2", "", 1), ("3", "<p>" * 20000, 1), ("4", LONG, 1)], "id string, raw_html string, markups int")
    got = {r["id"]: r for r in markup.clean_markup(df).collect()}
    assert got["1"]["clean_text"] is None and got["2"]["clean_text"] == "" and got["1"]["markups"] == [] and got["3"]["markups"] == ["html"]
    assert markup.found_markups(markup.clean_markup(df), "id").count() == 1 and markup.clean_markup(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "units",
    [
        ["The firm must report, e.g. a loss under Art. 5 at 8 a.m. on 3 May.", ' "Is it due?" asked the board.', " It is."],
        ["Das Institut meldet z. B. den Wert gemäß Art. 5 Abs. 2 bis zum 31. März.", " Die Aufsicht prüft."],
        ["保管機関は「確認する。」と回答した。", "親会社は保存する。"],
        ["“可以省略吗？”审计师问道。", "母公司应保存报表。"],
        ["Scope", "\n\nAny firm may choose:", "\n(a) one thing;", "\n(b) another."],
    ],
)
def test_sentences(units):
    sample = ["Die Aufsicht prüft.\n\nDie Meldung gilt gemäß Art. 5 und Abs. 2 bis zum 3. März 2024 und z. B. im März.\n\nDer März."] * 30
    text = "".join(units)
    ends = [sum(map(len, units[: i + 1])) for i in range(len(units))]
    assert sentences.fit(sample).decode(text) == ends


def test_sentence_column(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, " \n ", 0), (4, "One. Two", 0), (4, "One. Two", 0), (5, LONG, 0)], "doc_id long, text string, unit_no int")
    got = sentences.sentence_units(df)
    assert {r[0] for r in got.select("doc_id").distinct().collect()} == {4, 5} and got.where("doc_id = 5").count() == 4000
    assert sorted(r["end_char"] for r in got.where("doc_id = 4").collect()) == [4, 4, 8, 8] and sentences.sentence_units(df.limit(0)).count() == 0


def test_packing(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, None, 5, 300, 700, 1100, 2048, 5000])) for i in range(600)] + [(7, 900)] * 50
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("shard", F.lit("x"))
    got = packing.pack(df)
    assert got.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).where("n > 2048").count() == 0
    want = sum(n or 0 for _, n in rows)
    assert got.agg(F.sum("n_tokens")).first()[0] == want and got.where("n_tokens < 2048 and start_token > 0").count() == sum(n == 5000 for _, n in rows)
    r = packing.fill_report(got).first()
    assert r["n_containers"] <= 1.15 * r["least_containers"] and packing.pack(df.limit(0)).count() == 0
    sizes = [700, 700, 700, 640, 640, 640, 760, 760, 604, 1000, 1048]
    bins = packing.local_search(packing.best_fit(sizes, 2048), sizes, 2048)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 2048 for b in bins)


def test_the_bound_of_containers_holds():
    from collections import Counter

    rng = random.Random(6)
    for _ in range(300):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(0, 7))]
        least = len(sizes)

        def place(i, bins):
            nonlocal least
            if len(bins) >= least:
                return
            if i == len(sizes):
                least = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + sizes[i] <= 20:
                    place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
            place(i + 1, [*bins, sizes[i]])

        place(0, [])
        found = len(packing.local_search(packing.best_fit(sizes, 20), sizes, 20))
        assert packing.least_containers(Counter(sizes), 20) <= least <= found <= least + 1
    assert packing.least_containers({1100: 40}, 2048) == 40 and packing.least_containers({700: 40}, 2048) == 20


def test_packing_stops_where_nothing_can_improve(spark):
    import time

    began = time.time()
    df = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit(1100).alias("n_tokens"))
    assert packing.fill_report(packing.pack(df)).first()["n_containers"] == 100_000 and time.time() - began < 60


def test_packing_over_several_levels(spark):
    rng = random.Random(9)
    sizes = [rng.randint(200, 900) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long")
    got = packing.pack(df, shard=100)
    assert got.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).where("n > 2048").count() == 0
    assert got.count() == got.select("doc_id").distinct().count() == 3000
    r = packing.fill_report(got).first()
    assert r["n_containers"] <= 1.02 * r["least_containers"]


def test_twins(spark, duck, data, same_rows):
    from lexgraph.llm.queries import ORACLE, QUERIES

    for name, sql in ORACLE.items():
        assert same_rows(QUERIES[name](spark, data).toPandas(), duck.execute(sql).fetchdf()), name
