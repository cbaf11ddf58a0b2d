"""Traversal, hierarchy, path and component queries over the rulebook graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import traverse as T
from .graph import edges, nodes, twin


def _hub(s: SparkSession, d: str, nth: int = 0) -> str:
    """A well-connected rule or paragraph to start from: the nth of highest degree, ties by id."""
    known = nodes(s, d).where("node_type in ('rule', 'guidance_paragraph')").select("id")
    top = Q.degrees(edges(s, d)).join(known, "id", "left_semi").orderBy(F.desc("degree"), "id").limit(nth + 1).collect()
    return top[nth]["id"]


def _around(s: SparkSession, d: str, **kw) -> DataFrame:
    got, _ = T.neighbourhood(edges(s, d), nodes(s, d), _hub(s, d), **kw)
    return got.select("id", "depth", "node_type", "title")


def neighbourhood_1(s: SparkSession, d: str) -> DataFrame:
    return _around(s, d, depth=1, limit=30)


def neighbourhood_2(s: SparkSession, d: str) -> DataFrame:
    return _around(s, d, depth=2, limit=60)


def neighbourhood_explicit(s: SparkSession, d: str) -> DataFrame:
    return _around(s, d, depth=2, limit=40, only_explicit=True)


def neighbourhood_edges(s: SparkSession, d: str) -> DataFrame:
    _, e = T.neighbourhood(edges(s, d), nodes(s, d), _hub(s, d), depth=2, limit=60)
    return e


def induced_subgraph(s: SparkSession, d: str) -> DataFrame:
    n, _ = T.neighbourhood(edges(s, d), nodes(s, d), _hub(s, d), depth=2, limit=60)
    return T.induced(edges(s, d), n).select("id", "edge_type")


def descendants_recursive(s: SparkSession, d: str) -> DataFrame:
    return T.descendants(edges(s, d), nodes(s, d).where("node_type = 'part'").select("id"))


def contents_tree(s: SparkSession, d: str) -> DataFrame:
    """What every part contains within four levels, in natural order."""
    n = nodes(s, d)
    below = T.descendants(edges(s, d), n.where("node_type = 'part'").select("id"), 4)
    return below.join(n.select("id", "node_type", "title"), "id").select("root", "id", "depth", "node_type", *T.natural_key(F.col("title")))


def impact_walk(s: SparkSession, d: str) -> DataFrame:
    """What may be affected by a change of one rule: everything within three hops over stated edges."""
    e = edges(s, d).where(F.col("edge_type").isin("references", "amends", "contains"))
    return T.walks(e, _hub(s, d), 3)


def shortest_path_len(s: SparkSession, d: str) -> DataFrame:
    """Over edges of every type and any number of hops: null means unreachable."""
    n = nodes(s, d).where("node_type in ('chapter', 'guidance_section')").select("id")
    return T.shortest_path_lengths(edges(s, d), n.select(F.lit(_hub(s, d)).alias("source"), F.col("id").alias("target")))


def shortest_path_nodes(s: SparkSession, d: str) -> DataFrame:
    """The nodes and edges of a shortest path between the best-connected node and the last chapter by id."""
    last = nodes(s, d).where("node_type = 'chapter'").agg(F.max("id")).first()[0]
    return T.shortest_path(edges(s, d), _hub(s, d), last)


def walk_paths(s: SparkSession, d: str) -> DataFrame:
    """Walks of up to three stated edges from the best-connected node, node by node."""
    e = edges(s, d).where(F.col("edge_type").isin("references", "amends"))
    return T.walk_paths(e, _hub(s, d), 3).select("id", "hops", F.array_join("path", ">").alias("path"), F.array_join("edge_types", ">").alias("edge_types"))


def five_paths(s: SparkSession, d: str) -> DataFrame:
    """The five shortest paths of up to four stated edges between the two best-connected nodes (a report limit)."""
    e = edges(s, d).where(F.col("edge_type").isin("references", "amends", "contains"))
    p = T.walk_paths(e, _hub(s, d, 0), 4, _hub(s, d, 1), 5)
    return p.select("hops", F.array_join("path", ">").alias("path"), F.array_join("edge_types", ">").alias("edge_types"))


def components_sizes(s: SparkSession, d: str) -> DataFrame:
    """Sizes of the components over edges of every type."""
    return T.components(edges(s, d), nodes(s, d)).groupBy("component").agg(F.count("*").alias("n"))


def common_neighbours(s: SparkSession, d: str) -> DataFrame:
    return T.common_neighbours(edges(s, d), nodes(s, d), _hub(s, d, 0), _hub(s, d, 1))


def interesting_connections(s: SparkSession, d: str) -> DataFrame:
    """The 60 best shared-term edges, guidance first: a report of fixed length."""
    n = nodes(s, d).select("id", "node_type", "title")
    e = edges(s, d).where("edge_type = 'shares_defined_term'")
    both = e.join(n.toDF("from_node_id", "from_type", "from_title"), "from_node_id").join(n.toDF("to_node_id", "to_type", "to_title"), "to_node_id")
    guidance = (F.col("from_type").startswith("guidance") | F.col("to_type").startswith("guidance")).cast("int")
    why = F.concat(F.lit("both use "), F.coalesce(F.expr("nullif(trim(evidence_text), '')"), F.lit("a common term")))
    return both.select("id", "from_title", "to_title", guidance.alias("guidance"), F.round("confidence", 3).alias("confidence"), why.alias("why")).orderBy(F.desc("guidance"), F.desc("confidence"), "id").limit(60)


def _statement():
    kind = F.get_json_object("metadata_json", "$.document_type")
    return (F.col("node_type") == "guidance_document") & F.coalesce(kind.isin("supervisory_statement", "statement_of_policy"), F.lit(False))


def _preference():
    return F.when(F.col("node_type") == "guidance_document", 0).when(F.col("node_type") == "guidance_section", 1).otherwise(2)


def guidance_rollup(s: SparkSession, d: str) -> DataFrame:
    n, e = nodes(s, d), edges(s, d)
    ancestors = T.nearest_ancestor(e, n.where("node_type like 'guidance%'"), _statement(), _preference())
    return T.roll_up(e, ancestors).withColumn("confidence", F.round("confidence", 3))


def natural_sort_keys(s: SparkSession, d: str) -> DataFrame:
    return nodes(s, d).select("id", *T.natural_key(F.col("title")))


_HUBS = "hubs as (select id, row_number() over (order by degree desc, id) - 1 nth from (select id, count(*) degree from (select from_node_id id from e union all select to_node_id from e) group by id) x where id in (select id from n where node_type in ('rule', 'guidance_paragraph')))"
_HARD = "('site_structure', 'html_glossary_link', 'html_link', 'html_anchor', 'regex_rule_reference', 'instrument_listing', 'llm_reference')"


def _hops(depth: int, limit: int, where: str = "true") -> str:
    """CTEs seen{k}(id, depth, ord) and kept{k}(id) for the bounded search from the first hub."""
    sql = f"{_HUBS}, sym as materialized (select from_node_id node, to_node_id other, id, confidence from e where {where} union all select to_node_id, from_node_id, id, confidence from e where {where} and from_node_id <> to_node_id), seen0 as materialized (select id, 0 depth, 0::bigint ord from hubs where nth = 0)"
    for k in range(1, depth + 1):
        p = k - 1
        sql += f"""
        , inc{k} as materialized (select * from (select s.*, f.ord f_ord, row_number() over (partition by s.node order by confidence desc nulls last, s.id) r from sym s join seen{p} f on f.id = s.node and f.depth = {p}) where r <= {limit})
        , fresh{k} as materialized (select other, f_ord, r, row_number() over (order by f_ord, r, other) k from (select other, (min(row(f_ord, r))).f_ord f_ord, (min(row(f_ord, r))).r r from (select other, f_ord, r from inc{k} where other not in (select id from seen{p})) group by other))
        , seen{k} as materialized (select * from seen{p} union all select other, {k}, k + (select count(*) from seen{p}) - 1 from fresh{k} where k + (select count(*) from seen{p}) <= {limit})
        , kept{k} as materialized (select distinct id from inc{k} i where (select count(*) from fresh{k} x where x.f_ord < i.f_ord) + (select count(*) from seen{p}) < {limit})"""
    return sql.replace("(min(row(f_ord, r))).f_ord f_ord, (min(row(f_ord, r))).r r", "(min({'a': f_ord, 'b': r})).a f_ord, (min({'a': f_ord, 'b': r})).b r")


_AROUND = "select s.id, s.depth, node_type, title from seen{k} s join n on n.id = s.id"

QUERIES = {f.__name__: f for f in (neighbourhood_1, neighbourhood_2, neighbourhood_explicit, neighbourhood_edges, induced_subgraph, descendants_recursive, contents_tree, impact_walk, shortest_path_len, shortest_path_nodes, walk_paths, five_paths, components_sizes, common_neighbours, interesting_connections, guidance_rollup, natural_sort_keys)}
_SIMPLE = "simple as materialized (select distinct least(from_node_id, to_node_id) a, greatest(from_node_id, to_node_id) b from e where from_node_id <> to_node_id), sy as materialized (select a node, b other from simple union select b, a from simple)"
_DOWN = "parts as (select distinct from_node_id, to_node_id from e where edge_type = 'contains'), dn as (select id root, id, 0 depth from n where node_type = 'part' union select dn.root, p.to_node_id, dn.depth + 1 from dn join parts p on p.from_node_id = dn.id where dn.depth < {levels})"
_ROMAN = "(list_reduce(list_prepend(0, list_transform(range(1, length({r}) + 1), lambda i: case when i < length({r}) and (map{{'I':1,'V':5,'X':10,'L':50,'C':100,'D':500,'M':1000}})[upper({r})[i+1]] > (map{{'I':1,'V':5,'X':10,'L':50,'C':100,'D':500,'M':1000}})[upper({r})[i]] then -(map{{'I':1,'V':5,'X':10,'L':50,'C':100,'D':500,'M':1000}})[upper({r})[i]] else (map{{'I':1,'V':5,'X':10,'L':50,'C':100,'D':500,'M':1000}})[upper({r})[i]] end)), lambda a, b: a + b))"
_NAT = """case when regexp_matches(trim(title), '(?i)^annex') then 3 when regexp_matches(trim(title), '(?i)^art(icle|\\.)?\\s*\\d') then 2 else 0 end structure,
case when regexp_matches(trim(title), '(?i)^annex') then coalesce(case when regexp_extract(trim(title), '(?i)^annex\\s+([IVXLCDM]+)\\b', 1) <> '' then ROMAN end, 9999)
 else coalesce(try_cast(nullif(case when regexp_extract(trim(title), '(?i)^art(?:icle|\\.)?\\s*(\\d+)', 1) <> '' then regexp_extract(trim(title), '(?i)^art(?:icle|\\.)?\\s*(\\d+)', 1) else regexp_extract(trim(title), '(\\d+)', 1) end, '') as int), 9999) end ordinal,
lower(regexp_extract(trim(title), '\\d([A-Za-z])\\b', 1)) suffix, lower(trim(title)) raw""".replace("ROMAN", _ROMAN.format(r="regexp_extract(trim(title), '(?i)^annex\\s+([IVXLCDM]+)\\b', 1)"))
ORACLE = {
    "neighbourhood_1": twin(f"with {_hops(1, 30)} {_AROUND.format(k=1)}"),
    "neighbourhood_2": twin(f"with {_hops(2, 60)} {_AROUND.format(k=2)}"),
    "neighbourhood_explicit": twin(f"with {_hops(2, 40, 'source_method in ' + _HARD)} {_AROUND.format(k=2)}"),
    "neighbourhood_edges": twin(f"with {_hops(2, 60)} select id from kept1 union select id from kept2"),
    "induced_subgraph": twin(f"with {_hops(2, 60)}, m as (select s.id from seen2 s join n on n.id = s.id) select id, edge_type from e where from_node_id in (select id from m) and to_node_id in (select id from m)"),
    "descendants_recursive": twin(f"with recursive {_DOWN.format(levels=8)} select root, id, min(depth) depth from dn where depth > 0 group by 1, 2"),
    "contents_tree": twin(f"with recursive {_DOWN.format(levels=4)}, b as (select root, id, min(depth) depth from dn where depth > 0 group by 1, 2) select b.root, b.id, b.depth, node_type, {_NAT} from b join n on n.id = b.id"),
    "impact_walk": twin(f"with recursive {_HUBS}, sy as (select from_node_id a, to_node_id b from e where edge_type in ('references', 'amends', 'contains') union select to_node_id, from_node_id from e where edge_type in ('references', 'amends', 'contains')), wk as (select id, 0 hops from hubs where nth = 0 union select sy.b, hops + 1 from wk join sy on sy.a = wk.id where hops < 3) select id, min(hops) hops from wk group by 1"),
    "shortest_path_len": twin(f"with recursive {_HUBS}, sy as (select from_node_id a, to_node_id b from e union select to_node_id, from_node_id from e), wk(id, hops) using key (id) as (select id, 0 hops from hubs where nth = 0 union select sy.b, min(wk.hops) + 1 from wk join sy on sy.a = wk.id left join recurring.wk k on k.id = sy.b where k.id is null group by sy.b) select (select id from hubs where nth = 0) source, n.id target, wk.hops as length from n left join wk on wk.id = n.id where node_type in ('chapter', 'guidance_section')"),
    "shortest_path_nodes": twin(f"with recursive {_HUBS}, tg as (select max(id) id from n where node_type = 'chapter'), sy as (select from_node_id a, to_node_id b, id eid, edge_type from e where from_node_id <> to_node_id union select to_node_id, from_node_id, id, edge_type from e where from_node_id <> to_node_id), wk(id, hops, prev, eid, et) using key (id) as (select id, 0 hops, null::varchar prev, null::varchar eid, null::varchar et from hubs where nth = 0 union select b, hops + 1, a, eid, edge_type from (select sy.b, wk.hops, sy.a, sy.eid, sy.edge_type, row_number() over (partition by sy.b order by sy.a, sy.eid) r from wk join sy on sy.a = wk.id left join recurring.wk k on k.id = sy.b where k.id is null) where r = 1), bk as (select hops nth, wk.id, prev, eid, et from wk join tg on tg.id = wk.id union all select wk.hops, wk.id, wk.prev, wk.eid, wk.et from bk join wk on wk.id = bk.prev) select nth, id, eid edge_id, et edge_type from bk"),
    "walk_paths": twin(f"with recursive {_HUBS}, sy as (select from_node_id a, to_node_id b, edge_type from e where edge_type in ('references', 'amends') and from_node_id <> to_node_id union select to_node_id, from_node_id, edge_type from e where edge_type in ('references', 'amends') and from_node_id <> to_node_id), wk as (select id, 0 hops, [id] path, []::varchar[] et from hubs where nth = 0 union all select sy.b, hops + 1, list_append(path, sy.b), list_append(et, sy.edge_type) from wk join sy on sy.a = wk.id where hops < 3 and not list_contains(path, sy.b)) select id, hops, array_to_string(path, '>') path, array_to_string(et, '>') edge_types from wk where hops > 0"),
    "five_paths": twin(f"with recursive {_HUBS}, sy as (select from_node_id a, to_node_id b, edge_type from e where edge_type in ('references', 'amends', 'contains') and from_node_id <> to_node_id union select to_node_id, from_node_id, edge_type from e where edge_type in ('references', 'amends', 'contains') and from_node_id <> to_node_id), wk as (select id, 0 hops, [id] path, []::varchar[] et from hubs where nth = 0 union all select sy.b, hops + 1, list_append(path, sy.b), list_append(et, sy.edge_type) from wk join sy on sy.a = wk.id where hops < 4 and not list_contains(path, sy.b) and wk.id <> (select id from hubs where nth = 1)) select hops, array_to_string(path, '>') path, array_to_string(et, '>') edge_types from wk where id = (select id from hubs where nth = 1) order by hops, array_to_string(path, '>'), array_to_string(et, '>') limit 5"),
    "components_sizes": twin("with recursive ed as (select from_node_id a, to_node_id b from e union select to_node_id, from_node_id from e), ids as (select id from n union select a from ed), rc(id, r) using key (id) as (select id, id r from ids union select x.id, min(x.r) from (select ed.b id, rc.r r from rc join ed on ed.a = rc.id) x join recurring.rc k on k.id = x.id where x.r < k.r group by x.id) select r component, count(*) n from rc group by 1"),
    "common_neighbours": twin(f"with {_HUBS}, {_SIMPLE}, h0 as (select id from hubs where nth = 0), h1 as (select id from hubs where nth = 1), sh as (select other from sy where node = (select id from h0) intersect select other from sy where node = (select id from h1)) select x.id, x.degree, n.title from (select node id, count(*) degree from sy where node in (select other from sh) and node not in (select id from hubs where nth < 2) group by node order by degree desc, id limit 50) x left join n on n.id = x.id"),
    "interesting_connections": twin("select e.id, a.title from_title, b.title to_title, (a.node_type like 'guidance%' or b.node_type like 'guidance%')::int guidance, round(confidence, 3) confidence, 'both use ' || coalesce(nullif(trim(evidence_text), ''), 'a common term') why from e join n a on a.id = from_node_id join n b on b.id = to_node_id where edge_type = 'shares_defined_term' order by guidance desc, round(confidence, 3) desc, e.id limit 60"),
    "guidance_rollup": twin("""with recursive info as (select id, node_type = 'guidance_document' and coalesce(case when json_valid(metadata_json) then metadata_json->>'$.document_type' end in ('supervisory_statement', 'statement_of_policy'), false) good, case node_type when 'guidance_document' then 0 when 'guidance_section' then 1 else 2 end pref from n where node_type like 'guidance%'),
        up as (select to_node_id child, arg_min(i.id, {'a': i.pref, 'b': i.id}) parent, arg_min(i.good, {'a': i.pref, 'b': i.id}) pgood from e join info i on i.id = from_node_id where edge_type = 'contains' group by to_node_id),
        cl as (select id, id pos, good, 0 k from info union all select cl.id, up.parent, up.pgood, k + 1 from cl join up on up.child = cl.pos where not cl.good and k < 8),
        an as (select id, pos ancestor from cl where good and id <> pos),
        mv as (select coalesce(f.ancestor, from_node_id) from_node_id, coalesce(t.ancestor, to_node_id) to_node_id, edge_type, confidence, list_filter([case when f.id is not null then from_node_id end, case when t.id is not null then to_node_id end], lambda x: x is not null) r from e left join an f on f.id = from_node_id left join an t on t.id = to_node_id where edge_type = 'references')
        select from_node_id, to_node_id, edge_type, round(max(confidence), 3) confidence, array_to_string(list_sort(list_distinct(flatten(list(r)))), ',') rolled_up_from from mv where from_node_id <> to_node_id group by 1, 2, 3"""),
    "natural_sort_keys": twin(f"select id, {_NAT} from n"),
}
