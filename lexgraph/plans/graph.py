"""The rulebook graph of a data directory, and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.store import latest
from ..runtime import table


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Node records, each in its latest delivery."""
    return latest(table(spark, d, "node"), "id")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Edge records, each in its latest delivery."""
    return latest(table(spark, d, "edge"), "id")


def gedges(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "graph_edge"), "edge_id")


def twin(sql: str) -> str:
    """SQL with the views n (nodes), e (edges) and g (graph edges) in their latest deliveries."""
    views = "n as (select * exclude (_r) from (select *, row_number() over (partition by id order by loaded_at desc) _r from node) where _r = 1), e as (select * exclude (_r) from (select *, row_number() over (partition by id order by loaded_at desc) _r from edge) where _r = 1), g as (select * exclude (_r) from (select *, row_number() over (partition by edge_id order by loaded_at desc) _r from graph_edge) where _r = 1)"
    sql = sql.strip()
    if sql.lower().startswith("with recursive "):
        return f"with recursive {views}, {sql[15:]}"
    return f"with {views}, {sql[5:]}" if sql.lower().startswith("with ") else f"with {views} {sql}"


#: Hand-made records for operators whose cases are rare: appended to the tables by queries that say so.
SEED_NODES = [
    ("seed-part", "part", "Seeded Ledger Rules", "", "https://rules.hpo.example/seeded", "{}"),
    ("seed-rule-1", "rule", "Seeded Ledger Rules 1.1", "A firm must keep the ledger in rule 1.2 and Articles 4, 5(2) and 6. See also Seeded Audit Rules 7.3(a).", "https://rules.hpo.example/seeded/1-1", '{"part_title": "Seeded Ledger Rules", "rule_number": "1.1"}'),
    ("seed-rule-2", "rule", "Seeded Ledger Rules 1.2", "A firm must keep the ledger in rule 1.1 for 5 years.", "https://rules.hpo.example/seeded/1-2", '{"part_title": "Seeded Ledger Rules", "rule_number": "1.2"}'),
    ("seed-article-5", "chapter", "Article 5 Keeping", "", "", '{"part_title": "Seeded Ledger Rules", "article_number": "5"}'),
    ("seed-article-6", "chapter", "Article 6 Showing", "", "", '{"part_title": "Seeded Ledger Rules"}'),
    ("seed-audit", "rule", "Seeded Audit Rules 7.3", "A firm must show the ledger.", "", '{"part_title": "Seeded Audit Rules", "rule_number": "7.3"}'),
    ("seed-twin-a", "rule", "Twin", "The same text.", "", "{}"),
    ("seed-twin-b", "rule", "Twin", "The same text.", "", "{}"),
    ("seed-ref", "rule_reference", "seeded  ledger rules", "", "", '{"placeholder": true}'),
    ("seed-section-a", "guidance_section", "9 Seeded section", "", "https://rules.hpo.example/seeded#s9", "{}"),
    ("seed-doc-a", "guidance_document", "Seeded Document A", "", "https://rules.hpo.example/seeded/doc/", "{}"),
    ("seed-doc-b", "guidance_document", "Seeded Document B", "", "https://Rules.hpo.example/seeded/doc", "{}"),
    ("seed-section-b", "guidance_section", "9 Seeded Section", "", "", "{}"),
]
SEED_EDGES = [("seed-e1", "seed-twin-a", "seed-twin-b", "references", "html_link"), ("seed-e2", "seed-article-5", "seed-rule-1", "contains", "site_structure"), ("seed-e3", "seed-article-6", "seed-rule-1", "contains", "site_structure")]


def seeded_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    seed = spark.createDataFrame([(i, k, f"seed:{i}", t, x, u, m) for i, k, t, x, u, m in SEED_NODES], "id string, node_type string, stable_key string, title string, text string, url string, metadata_json string")
    return n.drop("loaded_at").unionByName(seed)


def seeded_edges(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d).select("id", "from_node_id", "to_node_id", "edge_type", "source_method")
    return e.unionByName(spark.createDataFrame(SEED_EDGES, e.schema))


def seeded(sql: str) -> str:
    """As twin, with the hand-made records in n and e."""
    quote = lambda row: "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in row) + ")"
    n = "select id, node_type, stable_key, title, text, url, metadata_json from n0 union all select a, b, 'seed:' || a, c, d, f, g from (values " + ", ".join(map(quote, SEED_NODES)) + ") v(a, b, c, d, f, g)"
    e = "select id, from_node_id, to_node_id, edge_type, source_method from e0 union all select * from (values " + ", ".join(map(quote, SEED_EDGES)) + ") v(a, b, c, d, f)"
    whole = twin(sql).replace("n as (select * exclude", "n0 as (select * exclude", 1).replace(", e as (select * exclude", ", e0 as (select * exclude", 1)
    return whole.replace(", g as (select * exclude", f", n as ({n}), e as ({e}), g as (select * exclude", 1)
