"""The best representative of each group of copies, by consistent bundles.

Fields that depend on each other form a bundle whose values are taken from one copy as a whole. Every distinct value
of a bundle is a candidate whose cost says how little it can be trusted (fields it lacks, trust rank of its source,
age). A branch-and-bound search picks one candidate per bundle with the least total cost such that functional
dependencies across bundles hold: where the group's copies show values for a determinant, the dependent value must
have been seen with it. Candidates are reduced by partial aggregation, and only the cheapest of them are brought
together; the bound tells whether those beyond could matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import cut

#: What is left, without anything but letters and digits, of values that stand in for an unknown one (fixed values).
STAND_INS = ["blank", "empty", "missing", "na", "nan", "nd", "nil", "nodata", "none", "notapplicable", "notassigned", "notavailable", "notfound", "notgiven", "notknown", "notprovided", "notrecorded", "notset", "notspecified", "notstated", "novalue", "null", "pending", "tba", "tbc", "tbd", "tobeadvised", "tobeannounced", "tobeconfirmed", "tobedecided", "tobedetermined", "unavailable", "undefined", "undetermined", "unknown", "unspecified", "xxx"]
#: Units of cost: a microsecond of age is 1, a trust rank and a lacking field so many. Sums over 250 bundles stay exact.
_RANK, _LACK, MOST_BUNDLES = 10**20, 10**32, 250
_NO_RANK = 2**31
_EPOCH = "0001-01-01 00:00:00"
#: Candidates of a coupled bundle, the cheapest first, that are searched; groups whose optimum they don't prove are
#: searched again with as many times more.
FIRST, MORE = 64, 64


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", "")


def real_value(c: Column) -> Column:
    """The value, or null if it is null, blank, without a letter or digit, or a stand-in for an unknown one."""
    bare = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    return F.when((bare != "") & ~bare.isin(STAND_INS), c)


def moment(c: Column) -> Column:
    """A date or time in one of several forms, days before months, to the microsecond; null if unreadable.

    A zone offset is taken off; a time without one stays as it is.
    """
    t = trimmed(c)
    zone = r"(?<=:\d\d|\.\d{1,9})\s*(?:Z|([+-])(\d\d):?(\d\d))$"
    bare = F.regexp_replace(t, zone, "")
    hours, minutes = (F.coalesce(F.regexp_extract(t, zone, g).try_cast("int"), F.lit(0)) for g in (2, 3))
    shift = F.when(F.regexp_extract(t, zone, 1) == "-", -1).otherwise(1)
    iso = F.when(bare.rlike(r"^\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d{1,9})?)?)?$"), bare.try_cast("timestamp_ntz")) - F.make_dt_interval(hours=hours * shift, mins=minutes * shift)
    forms = ["d/M/yyyy", "d.M.yyyy", "d-M-yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy/M/d"]
    return F.coalesce(iso, *(F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in forms))


@dataclass(frozen=True)
class Dependency:
    """determinant -> dependent, fields of different bundles."""

    determinant: str
    dependent: str


def _search(bundles: dict[str, list[tuple[int, str, dict]]], deps: list[Dependency], seen: dict[tuple[str, str], set[tuple[str, str | None]]]) -> tuple[int, dict[str, tuple[int, str, dict]]] | None:
    """Branch and bound over the candidates (cost, node, values) of each bundle, sorted by cost: (cost, choice)."""
    names = sorted(bundles, key=lambda b: (len(bundles[b]), b))
    floor = [0] * (len(names) + 1)
    for i in range(len(names) - 1, -1, -1):
        floor[i] = floor[i + 1] + bundles[names[i]][0][0]
    best: tuple[tuple[int, tuple[str, ...]], dict] | None = None
    shown = {k: {a for a, _ in pairs} for k, pairs in seen.items()}

    def fits(values: dict) -> bool:
        for d in deps:
            a, b = values.get(d.determinant), values.get(d.dependent)
            if a is not None and b is not None:
                k = (d.determinant, d.dependent)
                if a in shown.get(k, ()) and (a, b) not in seen[k]:
                    return False
        return True

    def branch(i: int, cost: int, chosen: dict, values: dict) -> None:
        nonlocal best
        if best is not None and cost + floor[i] > best[0][0]:
            return
        if i == len(names):
            key = (cost, tuple(chosen[n][1] for n in sorted(chosen)))
            if best is None or key < best[0]:
                best = (key, dict(chosen))
            return
        for c in bundles[names[i]]:
            if best is not None and cost + c[0] + floor[i + 1] > best[0][0]:
                break
            merged = values | c[2]
            if fits(merged):
                chosen[names[i]] = c
                branch(i + 1, cost + c[0], chosen, merged)
                del chosen[names[i]]

    branch(0, 0, {}, {})
    return (best[0][0], best[1]) if best else None


def _solve(cands: DataFrame, bundles: dict[str, list[str]], deps: list[Dependency], whole: tuple[str, ...], coupled: set[str], keep: int) -> DataFrame:
    """The search of each group of cands(group_id, bundle, kind, cost, node_id, vals), streamed group by group.

    A group whose optimum might need a candidate beyond the `keep` cheapest gives one row without a bundle.
    """
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(group, rows_of) -> list[tuple]:
            options: dict[str, list] = {}
            pairs: dict[tuple[str, str], set] = {}
            for b, kind, cost, node, vals in rows_of:
                if kind:
                    a, _, c = b.partition(">")
                    pairs.setdefault((a, c), set()).add((vals[0], vals[1]))
                else:
                    options.setdefault(b, []).append((int(cost), node, {f: v for f, v in zip(bundles[b], vals) if v is not None}))
            for b, o in options.items():
                o.sort(key=lambda c: c[:2])
            least = {b: o[0][0] for b, o in options.items()}
            beyond = [sum(least.values()) - least[b] + o[-1][0] for b, o in options.items() if b in coupled and len(o) > keep]
            for b in coupled & options.keys():
                # Where the copies' values allow no consistent whole, a bundle may stay empty; nothing costs more.
                options[b].append(((len(bundles[b]) + 1) * _LACK - 1, "", {}))
            cost, picked = _search(options, deps, pairs)
            if beyond and cost >= min(beyond):
                return [(group, None, None, None, None)]
            out = []
            for b, c in picked.items():
                out += [(group, b, f, c[1], c[2].get(f)) for f in bundles[b] if f in c[2] or b in whole]
            return out

        def out(rows_out: list[tuple]) -> pa.RecordBatch:
            g, b, f, n, v = (list(x) for x in zip(*rows_out))
            return pa.RecordBatch.from_arrays([pa.array(g, gtype), *(pa.array(x, pa.string()) for x in (b, f, n, v))], ["group_id", "bundle", "field_name", "node_id", "value"])

        gtype, now, waiting, done = None, None, [], []
        for b in batches:
            gtype = b.schema.field("group_id").type
            for g, bundle, kind, cost, node, vals in zip(*(b.column(c).to_pylist() for c in ("group_id", "bundle", "kind", "cost", "node_id", "vals"))):
                if waiting and g != now:
                    done += solve(now, waiting)
                    waiting = []
                    if len(done) > 5000:
                        yield out(done)
                        done = []
                now = g
                waiting.append((bundle, kind, cost, node, vals))
        if waiting:
            done += solve(now, waiting)
        if done:
            yield out(done)

    schema = T.StructType([T.StructField("group_id", cands.schema["group_id"].dataType), *(T.StructField(c, T.StringType()) for c in ("bundle", "field_name", "node_id", "value"))])
    return cands.repartition("group_id").sortWithinPartitions("group_id").mapInArrow(run, schema)


def best_bundles(copies: DataFrame, bundles: dict[str, list[str]], dependencies: list[Dependency] | None = None, whole: tuple[str, ...] = (), first: int = FIRST) -> DataFrame:
    """group_id, bundle, field_name, node_id, value: the value kept for each field and the copy it is from.

    copies(group_id, node_id, trust_rank, at, and a string column per field; null is no real value), one row per
    copy. A bundle costs by the fields it lacks, then the trust rank of its copy (null: after all), then its age to
    the microsecond (no time: before all); the costs of the bundles are added up in that order. A bundle that no copy
    has a real value for gives no row; one named in `whole` is kept also without real values and gives a row for each
    of its fields. Ties go to the smallest node_id. Fields of bundles with dependencies must be in one bundle only.
    Extra columns are ignored and an empty table gives an empty result.

    A group may be of any size: copies with the same values are one candidate, and only the `first` cheapest
    candidates of a coupled bundle are brought together. A bound shows for which groups the best can't lie beyond
    them; the others are searched again with more.
    """
    deps = [d for d in dependencies or []]
    if len(bundles) > MOST_BUNDLES:
        raise ValueError(f"at most {MOST_BUNDLES} bundles")
    ends = {x for d in deps for x in (d.determinant, d.dependent)}
    home = {f: b for b, fs in bundles.items() for f in fs if f in ends}
    coupled = set(home.values())
    micros = F.coalesce(F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), F.col("at")), F.lit(0))
    rank = F.coalesce(F.col("trust_rank").cast("long"), F.lit(_NO_RANK))
    base = rank.cast("decimal(12,0)") * F.lit(Decimal(_RANK)) + (F.lit(10**18) - micros).cast("decimal(20,0)")
    rows = copies.withColumn("_base", base.cast("decimal(38,0)"))

    def candidate(b: str) -> Column:
        fs = bundles[b]
        real = sum((F.col(f).isNotNull().cast("int") for f in fs), F.lit(0))
        cost = (F.col("_base") + (F.lit(len(fs)) - real).cast("decimal(5,0)") * F.lit(Decimal(_LACK))).cast("decimal(38,0)")
        made = F.struct(F.lit(b).alias("bundle"), cost.alias("cost"), F.array(*(F.col(f).cast("string") for f in fs)).alias("vals"))
        return made if b in whole else F.when(real > 0, made)

    every = rows.select("group_id", "node_id", F.explode(F.array(*(candidate(b) for b in bundles))).alias("c")).where("c is not null").select("group_id", "node_id", "c.bundle", "c.cost", "c.vals")
    best = F.min(F.struct("cost", "node_id", "vals")).alias("m")
    free = every.where(~F.col("bundle").isin(sorted(coupled))) if coupled else every
    alone = free.groupBy("group_id", "bundle").agg(best).select("group_id", "bundle", F.lit(0).alias("kind"), "m.cost", "m.node_id", "m.vals")
    if not coupled:
        return _solve(alone, bundles, deps, whole, coupled, first)
    done = _solve(alone, bundles, deps, whole, set(), first)
    joint = every.where(F.col("bundle").isin(sorted(coupled)))
    by_value = cut(joint.groupBy("group_id", "bundle", "vals").agg(F.min(F.struct("cost", "node_id")).alias("m")).select("group_id", "bundle", "m.cost", "m.node_id", "vals"))
    todo, keep = by_value, first
    while True:
        nth = F.row_number().over(W.partitionBy("group_id", "bundle").orderBy("cost", "node_id", "vals"))
        kept = cut(todo.withColumn("nth", nth).where(F.col("nth") <= keep + 1).drop("nth"))
        cands = kept.select("group_id", "bundle", F.lit(0).alias("kind"), "cost", "node_id", "vals")
        for d in deps:
            # Of each determinant's value kept: the kept dependents seen with it, and a null for any others.
            def side(f: str, name: str) -> DataFrame:
                return kept.where(F.col("bundle") == home[f]).select("group_id", F.col("vals")[bundles[home[f]].index(f)].alias(name)).where(F.col(name).isNotNull()).distinct()

            seen = rows.select("group_id", F.col(d.determinant).cast("string").alias("a"), F.col(d.dependent).cast("string").alias("b")).where("a is not null and b is not null").distinct()
            seen = seen.join(side(d.determinant, "a"), ["group_id", "a"], "left_semi").join(side(d.dependent, "b").withColumn("known", F.lit(True)), ["group_id", "b"], "left")
            pairs = seen.select("group_id", F.lit(f"{d.determinant}>{d.dependent}").alias("bundle"), F.array("a", F.when(F.col("known"), F.col("b"))).alias("vals")).distinct()
            cands = cands.unionByName(pairs.select("group_id", "bundle", F.lit(1).alias("kind"), F.lit(None).cast("decimal(38,0)").alias("cost"), F.lit("").alias("node_id"), "vals"))
        found = cut(_solve(cands, bundles, deps, whole, coupled, keep))
        done = done.unionByName(found.where("bundle is not null"))
        unproven = found.where("bundle is null").select("group_id").distinct()
        if unproven.isEmpty():
            return done
        todo, keep = by_value.join(unproven, "group_id", "left_semi"), keep * MORE


def surviving_copy(copies: DataFrame, fields: list[str]) -> DataFrame:
    """group_id, node_id: the copy with the most real values, then the most trusted, latest, smallest id.

    All fields are one bundle, which is kept whole.
    """
    return best_bundles(copies, {"record": fields}, whole=("record",)).select("group_id", "node_id").distinct()


def read_copies(groups: DataFrame, nodes: DataFrame, trust: DataFrame, fields: list[str]) -> DataFrame:
    """group_id, node_id, trust_rank, at and the real values of the fields, for each copy of a group of two or more.

    Of several deliveries of a node the latest counts. Unreadable metadata holds nothing; sources are compared
    without surrounding spaces and case, an unknown one ranks after all, an unreadable date before all.
    """
    member = groups.where("group_id is not null and node_id is not null").select("group_id", "node_id").distinct()
    large = member.groupBy("group_id").count().where("count > 1").select("group_id")
    member = member.join(large, "group_id")
    latest = nodes.select(F.col("id").alias("node_id"), "metadata_json", "loaded_at").groupBy("node_id").agg(F.max_by("metadata_json", F.struct("loaded_at", "metadata_json")).alias("meta"))
    json = F.try_parse_json("meta")
    get = lambda f: F.try_variant_get(F.col("_v"), f"$.{f}", "string")
    got = member.join(latest, "node_id", "left").withColumn("_v", json)
    got = got.select("group_id", "node_id", F.lower(trimmed(get("source"))).alias("_source"), moment(get("retrieved_at")).alias("at"), *(real_value(get(f)).alias(f) for f in fields))
    rank = trust.select(F.lower(trimmed(F.col("source_name"))).alias("_source"), "trust_rank").groupBy("_source").agg(F.min("trust_rank").alias("trust_rank"))
    return got.join(rank, "_source", "left").drop("_source")
