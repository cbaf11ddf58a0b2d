"""Queries of problem 5: one surviving record for each set of copies of a guidance document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, table
from .survivor import Dependency, best_bundles, read_copies, surviving_copy

FIELDS = ["document_code", "document_type", "rulebook_date", "contact_team", "page_count"]


def _copies(spark: SparkSession, d: str) -> DataFrame:
    return cut(read_copies(table(spark, d, "guidance_group"), table(spark, d, "node"), table(spark, d, "source_trust"), FIELDS))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Field by field and the whole record: a bundle for each field, and one of all fields that is kept whole."""
    kept = best_bundles(_copies(spark, d), {f: [f] for f in FIELDS} | {"record": FIELDS}, whole=("record",))
    return kept.select("group_id", F.col("bundle").alias("field_name"), "node_id").distinct()


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each group, with code and type as one bundle and the date depending on the code."""
    copies = _copies(spark, d)
    kept = best_bundles(copies, {"document": ["document_code", "document_type"]} | {f: [f] for f in FIELDS[2:]}, [Dependency("document_code", "rulebook_date")])
    wide = kept.groupBy("group_id").agg(*(F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in FIELDS))
    return surviving_copy(copies, FIELDS).join(wide, "group_id", "left")


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    """is_canonical of every document in a group of two or more: 1 on the surviving copy, 0 on the others."""
    copies = _copies(spark, d)
    best = surviving_copy(copies, FIELDS).withColumnRenamed("node_id", "survivor")
    docs = table(spark, d, "canonical_guidance_document").select(F.col("id").alias("node_id")).distinct()
    return copies.select("group_id", "node_id").join(docs, "node_id").join(best, "group_id").select("group_id", "node_id", (F.col("node_id") == F.col("survivor")).cast("long").alias("is_canonical"))


_COPIES = """
with m as (select group_id, node_id from (select distinct group_id, node_id from guidance_group) g where group_id in (select group_id from (select distinct group_id, node_id from guidance_group) group by group_id having count(*) > 1)),
l as (select id, max_by(metadata_json, loaded_at) meta from node group by id),
j as (select m.group_id, m.node_id, try_cast(l.meta as json) v from m left join l on l.id = m.node_id),
k as (select group_id, node_id, lower(trim(v->>'$.source')) s, trim(v->>'$.retrieved_at') r, v->>'$.document_code' document_code, v->>'$.document_type' document_type, v->>'$.rulebook_date' rulebook_date, v->>'$.contact_team' contact_team, v->>'$.page_count' page_count from j),
c as (select k.*, coalesce(t.trust_rank, 99999) rank, coalesce(try_strptime(r, ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d', '%d/%m/%Y', '%d %B %Y']), timestamp '0001-01-01') ts from k left join source_trust t on t.source_name = k.s),
u as (unpivot (select group_id, node_id, rank, ts, document_code, document_type, rulebook_date, contact_team, page_count from c) on document_code, document_type, rulebook_date, contact_team, page_count into name field_name value x),
real as (select * from u where lower(trim(x)) not in ('', '-', '—', '?', 'n/a', 'null', 'none', 'unknown', 'not known', 'tbc', 'to be confirmed')),
f as (select group_id, field_name, node_id, row_number() over (partition by group_id, field_name order by rank, ts desc, node_id) n from real),
s as (select c.group_id, c.node_id, row_number() over (partition by c.group_id order by (select count(*) from real r where r.group_id = c.group_id and r.node_id = c.node_id) desc, c.rank, c.ts desc, c.node_id) n from c)
"""

_RECORDS = """,
w as (select group_id, node_id, rank, epoch_us(ts) us, nullif(max(case when field_name = 'document_code' then x end), '') code, max(case when field_name = 'document_type' then x end) typ, max(case when field_name = 'rulebook_date' then x end) dat from real group by all),
pr as (select distinct group_id, code, dat from w where code is not null and dat is not null),
dc as (select group_id, node_id, rank, us, code, typ, (code is null)::int + (typ is null)::int lack from w where code is not null or typ is not null),
dd as (select group_id, node_id, rank, us, dat from w where dat is not null),
bt as (select coalesce(dc.group_id, dd.group_id) group_id, code, typ, dat, row_number() over (partition by coalesce(dc.group_id, dd.group_id) order by coalesce(lack, 0), coalesce(dc.rank, 0) + coalesce(dd.rank, 0), coalesce(dc.us, 0) + coalesce(dd.us, 0) desc, dc.node_id, dd.node_id) k
 from dc full join dd on dc.group_id = dd.group_id
 where dc.code is null or dd.dat is null or exists (select 1 from pr where pr.group_id = dc.group_id and pr.code = dc.code and pr.dat = dd.dat) or not exists (select 1 from pr where pr.group_id = dc.group_id and pr.code = dc.code)),
fv as (select group_id, max(case when field_name = 'contact_team' then x end) contact_team, max(case when field_name = 'page_count' then x end) page_count from (select r.group_id, r.field_name, r.x, row_number() over (partition by r.group_id, r.field_name order by rank, ts desc, node_id) n from real r) where n = 1 group by 1)
select s.group_id, s.node_id, bt.code document_code, bt.typ document_type, bt.dat rulebook_date, contact_team, page_count
from s left join bt on bt.group_id = s.group_id and bt.k = 1 left join fv on fv.group_id = s.group_id where s.n = 1
"""

QUERIES = {"p5_found": p5_found, "p5_records": p5_records, "p5_canonical": p5_canonical}
ORACLE = {
    "p5_found": _COPIES + "select group_id, field_name, node_id from f where n = 1 union all select group_id, 'record', node_id from s where n = 1",
    "p5_records": _COPIES.rstrip() + _RECORDS,
    "p5_canonical": _COPIES + "select s.group_id, s.node_id, cast(s.n = 1 as bigint) is_canonical from s where s.node_id in (select id from canonical_guidance_document)",
}
