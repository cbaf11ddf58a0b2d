"""The k most similar vectors of every vector by collision counting.

Vectors are routed to cells (centroids fitted on a bounded sample; every vector is indexed); cells that grow too large
are parted again by centroids of their own, so that the cells' number grows with the table and their size doesn't.
Inside a cell each of M random projections gives a sorted array of the cell's vectors. A query starts from its place
in each array and walks outward, level by level (virtual rehashing), counts in how many arrays it came by a vector,
and verifies those it met often enough by their exact cosine.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import cut

#: Projections, the width of a window in standard deviations of the gap at the level's distance, and the collisions
#: that make a candidate: a vector at the level's distance is missed with a probability of less than 0.001.
M, WIDTH, COLLISIONS = 24, 2.0, 19
#: Levels of cosine at which windows are tried; at the last one they hold everything.
LEVELS = (0.95, 0.9, 0.75, 0.5, 0.0, -1.0)
#: Vectors a centroid stands for, most centroids of a model and of a parted cell, and vectors of a cell that isn't parted.
PER_CELL, MOST_CELLS, BLOCK = 256, 1024, 2048
#: Cells a query looks into, and parts of each if it is parted; queries that one task sends through a block.
PROBES, PARTS, QUERIES = 12, 4, 16384
#: Vectors and bytes of the sample on which centroids are fitted, per model; rounds of fitting; sample of a parted cell per centroid.
SAMPLE, SAMPLE_BYTES, ROUNDS, PER_PART = 20_000, 64 << 20, 6, 8


def parse_vector(s: str | None) -> list[float] | None:
    """A list of finite numbers, not all zero; None for anything else."""
    if not s:
        return None
    try:
        v = json.loads(s)
    except ValueError:
        return None
    if type(v) is not list or not v:
        return None
    total = 0.0
    for x in v:
        if type(x) is not float and type(x) is not int:
            return None
        try:
            total += abs(float(x))
        except OverflowError:
            return None
    return [float(x) for x in v] if math.isfinite(total) and total > 0 else None


def usable_vectors(df: DataFrame, key: str = "node_id", model: str = "model_name", vector: str = "vector_json", created: str = "created_at") -> DataFrame:
    """id, model, vec (unit length): one row per record and model.

    A vector is usable if it is a list of finite numbers, not all zero, of its model's most frequent length (of two
    equally frequent, the longer); of several the latest `created` counts, then the greater text. Rows without an id
    or a model name don't take part.
    """
    src = df.select(F.col(key).cast("string").alias("id"), F.col(model).cast("string").alias("model"), F.col(vector).cast("string").alias("v"), F.col(created).cast("string").alias("at")).where("id is not null and model is not null and v is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, vecs = [], []
            for i, s in enumerate(b.column(2).to_pylist()):
                v = parse_vector(s)
                if v is not None:
                    a = np.array(v)
                    a = a / np.abs(a).max()
                    keep.append(i)
                    vecs.append(a / np.sqrt(a @ a))
            if keep:
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(3).take(at), b.column(2).take(at), pa.array(vecs, pa.list_(pa.float64()))], ["id", "model", "at", "raw", "vec"])

    parsed = cut(src.mapInArrow(run, "id string, model string, at string, raw string, vec array<double>").withColumn("dim", F.size("vec")))
    usual = parsed.groupBy("model", "dim").count().groupBy("model").agg(F.max_by("dim", F.struct("count", "dim")).alias("dim"))
    latest = parsed.join(usual, ["model", "dim"]).groupBy("id", "model").agg(F.max_by("vec", F.struct(F.coalesce("at", F.lit("")), "raw")).alias("vec"))
    return latest


def _means(x: np.ndarray, k: int) -> np.ndarray:
    """k centroids of the rows by spherical k-means."""
    c = x[np.random.default_rng(7).choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        home = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return c


def _matrix(vec: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(vec, pa.ChunkedArray):
        vec = vec.combine_chunks()
    return np.array(vec.flatten()).reshape(len(vec), -1)


def fit_cells(classes: DataFrame, most: int = MOST_CELLS, per: int = PER_CELL) -> dict[str, np.ndarray]:
    """Centroids of each model, fitted on a bounded sample: at most SAMPLE vectors or SAMPLE_BYTES of a model."""
    out = {}
    for r in classes.groupBy("model").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).orderBy("model").collect():
        share = min(1.0, SAMPLE / r["n"], SAMPLE_BYTES / (8 * r["dim"] * r["n"]))
        mine = classes.where((F.col("model") == r["model"]) & (F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(1 << 30)) < share * (1 << 30)))
        got = mine.select("cls", "vec").toArrow().sort_by("cls")
        if got.num_rows:
            x = _matrix(got.column("vec"))
            out[r["model"]] = _means(x, max(1, min(most, r["n"] // per, len(x))))
    return out


def _nearest_cells(x: np.ndarray, c: np.ndarray, probes: int) -> np.ndarray:
    """For each vector its nearest centroids, nearest first."""
    p = min(probes, len(c))
    s = x @ c.T
    near = np.argpartition(-s, p - 1, axis=1)[:, :p] if p < len(c) else np.tile(np.arange(len(c)), (len(x), 1))
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)


def _route(vectors: DataFrame, cells, probes: int) -> DataFrame:
    """One row per vector and cell it is sent to; the first is its home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cents = cells.value
        for b in batches:
            models = np.array(b.column("model").to_pylist(), dtype=object)
            vec = b.column("vec")
            row, cell = [], []
            for m in sorted(set(models)):
                at = np.flatnonzero(models == m)
                c = cents.get(m)
                near = np.zeros((len(at), 1), np.int64) if c is None else _nearest_cells(_matrix(vec.take(pa.array(at))), c, probes)
                row.append(np.repeat(at, near.shape[1]))
                cell.append(near.ravel())
            if row:
                r = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([b.column("cls").take(r), b.column("model").take(r), pa.array(np.concatenate(cell).astype(np.int32)), vec.take(r)], ["cls", "model", "cell", "vec"])

    return vectors.select("cls", "model", "vec").mapInArrow(run, "cls string, model string, cell int, vec array<double>")


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) for the runs of equal keys in sorted batches; a key may come again in the next batch."""
    for b in batches:
        if not b.num_rows:
            continue
        ids = list(zip(*(b.column(c).to_pylist() for c in key)))
        starts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
        for s, e in zip(starts, starts[1:]):
            yield ids[s], b.slice(s, e - s)


def _fit_parts(homes: DataFrame, large: DataFrame, per: int, most: int) -> DataFrame:
    """model, cell, sub, vec: centroids of the parts of each cell in large(model, cell, n), each fitted in one task on a bounded sample."""
    parts = F.least(F.lit(most), F.ceil(F.col("n") / per)).cast("int")
    share = F.least(F.lit(1.0), parts * PER_PART / F.col("n"))
    wanted = homes.join(large.select("model", "cell", parts.alias("k"), share.alias("share")), ["model", "cell"])
    sample = wanted.where(F.pmod(F.xxhash64("cls", F.lit(2)), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("model", "cell", "k", "cls", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fit(key, rows):
            x = np.concatenate(rows)
            c = _means(x, min(key[2], len(x)))
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(c), pa.string()), pa.array([key[1]] * len(c), pa.int32()), pa.array(np.arange(len(c), dtype=np.int32)), pa.array(list(c), pa.list_(pa.float64()))], ["model", "cell", "sub", "vec"])

        now, rows = None, []
        for key, b in _groups(batches, ["model", "cell", "k"]):
            if now is not None and key != now:
                yield fit(now, rows)
                rows = []
            now = key
            rows.append(_matrix(b.column("vec")))
        if rows:
            yield fit(now, rows)

    return sample.repartition("model", "cell").sortWithinPartitions("model", "cell", "cls").mapInArrow(run, "model string, cell int, sub int, vec array<double>")


def _part(routed: DataFrame, large: DataFrame, cents: DataFrame, probes: int) -> DataFrame:
    """cls, model, cell, sub, vec: vectors of cells in large(model, cell, n) sent to their nearest parts.

    The centroids of a cell go before its vectors in the stream of a task; a cell with many vectors has several tasks.
    """
    sized = large.join(routed.groupBy("model", "cell").agg(F.count("*").alias("m")), ["model", "cell"]).select("model", "cell", F.ceil(F.col("m") / QUERIES).cast("int").alias("salts"))
    before = cents.join(sized, ["model", "cell"]).select("model", "cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "sub", F.lit("").alias("cls"), "vec")
    after = routed.join(sized, ["model", "cell"]).select("model", "cell", F.pmod(F.xxhash64("cls"), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"), F.lit(0).alias("sub"), "cls", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, c = None, []
        for key, b in _groups(batches, ["model", "cell", "salt", "kind"]):
            if key[3] == 0:
                c = (c if of == key[:3] else []) + [_matrix(b.column("vec"))]
                of = key[:3]
                continue
            if len(c) > 1:
                c = [np.concatenate(c)]
            near = _nearest_cells(_matrix(b.column("vec")), c[0], probes)
            r = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column("cls").take(r), b.column("model").take(r), b.column("cell").take(r), pa.array(near.ravel().astype(np.int32)), b.column("vec").take(r)], ["cls", "model", "cell", "sub", "vec"])

    ordered = before.unionByName(after).repartition("model", "cell", "salt").sortWithinPartitions("model", "cell", "salt", "kind", "sub")
    return ordered.mapInArrow(run, "cls string, model string, cell int, sub int, vec array<double>")


class Block:
    """The sorted arrays of up to BLOCK vectors, one for each projection."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.axes = np.random.default_rng(x.shape[1]).standard_normal((x.shape[1], M))
        h = x @ self.axes
        self.order = np.argsort(h, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(h, self.order, 0)

    def search(self, q: np.ndarray, want: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, cosine) of the best `want` vectors for each query and what ties with the last, those of at least `least`."""
        n, hq = len(self.x), q @ self.axes
        open_q = np.arange(len(q))
        hits = np.zeros((len(q), n), np.int16)
        place = np.stack([np.searchsorted(self.values[:, j], hq[:, j]) for j in range(M)], axis=1)
        low, high = place, place
        qs, xs, cs = [], [], []
        levels = [v for v in LEVELS if v > least]
        for level in [*levels, least] if least > LEVELS[-1] else levels:
            last = level == (least if least > LEVELS[-1] else LEVELS[-1])
            w = WIDTH * math.sqrt(2 - 2 * level)
            further = [(np.searchsorted(self.values[:, j], hq[open_q, j] - w), np.searchsorted(self.values[:, j], hq[open_q, j] + w, "right")) for j in range(M)]
            low_now, high_now = (np.stack(s, axis=1) for s in zip(*further))
            # Outward from where the windows ended: only the vectors come by for the first time are counted.
            seen = np.zeros(len(open_q) * n, np.int64)
            for a, b in ((low_now, low), (high, high_now)):
                size = np.maximum(b - a, 0)
                for j in range(M):
                    s = size[:, j]
                    at = np.repeat(a[:, j], s) + np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
                    flat = np.repeat(np.arange(len(open_q)) * n, s) + self.order[at, j]
                    # A vector comes by once in an array, so no place is counted twice at a time.
                    seen[flat] += 1
            hits += seen.reshape(len(open_q), n).astype(np.int16)
            low, high = low_now, high_now
            i, k = np.nonzero(hits >= COLLISIONS) if not (last and level <= -1) else np.nonzero(hits >= 0)
            cos = np.einsum("ij,ij->i", q[open_q[i]], self.x[k])
            # A query is done when the windows of this level hold all it wants.
            done = np.bincount(i[cos >= level], minlength=len(open_q)) >= want
            take = done[i] | last
            qs.append(open_q[i[take]])
            xs.append(k[take])
            cs.append(cos[take])
            more = ~done
            open_q, hits, low, high = open_q[more], hits[more], low[more], high[more]
            if last or not len(open_q):
                break
        i, j, c = np.concatenate(qs), np.concatenate(xs), np.concatenate(cs)
        ok = c >= least
        i, j, c = i[ok], j[ok], c[ok]
        order = np.lexsort((-c, i))
        i, j, c = i[order], j[order], c[order]
        if not len(i):
            return i, j, c
        first = np.concatenate([[0], np.flatnonzero(i[1:] != i[:-1]) + 1])
        rank = np.arange(len(i)) - np.repeat(first, np.diff(np.concatenate([first, [len(i)]])))
        edge = np.full(len(q), -np.inf)
        edge[i[rank == want - 1]] = c[rank == want - 1]
        ok = c >= edge[i] - 1e-9
        return i[ok], j[ok], c[ok]


def _search(queries: DataFrame, index: DataFrame, want: int, least: float, block: int) -> DataFrame:
    """cls, other, cosine: what the queries (cls, model, cell, sub, vec) find in the index of the same cells.

    A cell's index is cut into blocks, and its queries into as many streams as they need; each task has the vectors
    of one block before the queries that come by.
    """
    key = ["model", "cell", "sub"]
    counts = index.groupBy(*key).agg(F.count("*").alias("n")).join(queries.groupBy(*key).agg(F.count("*").alias("m")), key)
    counts = cut(counts.select(*key, F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil(F.col("m") / QUERIES).cast("int").alias("streams")))

    def every(c: str):
        return F.explode(F.sequence(F.lit(0), F.col(c) - 1))

    before = index.join(counts, key).select(*key, F.pmod(F.xxhash64("cls"), "blocks").cast("int").alias("no"), every("streams").alias("stream"), F.lit(0).alias("kind"), "cls", "vec")
    after = queries.join(counts, key).select(*key, every("blocks").alias("no"), F.pmod(F.xxhash64("cls"), "streams").cast("int").alias("stream"), F.lit(1).alias("kind"), "cls", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, names, rows, made = None, [], [], None
        for k, b in _groups(batches, [*key, "no", "stream", "kind"]):
            if k[-1] == 0:
                if of != k[:-1]:
                    of, names, rows = k[:-1], [], []
                names.append(b.column("cls"))
                rows.append(_matrix(b.column("vec")))
                made = None
                continue
            if of != k[:-1]:
                continue
            if made is None:
                made = Block(np.concatenate(rows))
                names = [pa.concat_arrays(names)]
            x = _matrix(b.column("vec"))
            step = max(64, (1 << 20) // len(made.x))
            for low in range(0, len(x), step):
                i, j, c = made.search(x[low : low + step], want, least)
                if len(i):
                    yield pa.RecordBatch.from_arrays([b.column("cls").take(pa.array(low + i)), names[0].take(pa.array(j)), pa.array(np.round(c, 9))], ["cls", "other", "cosine"])

    order = [*key, "no", "stream"]
    return before.unionByName(after).repartition(*order).sortWithinPartitions(*order, "kind").mapInArrow(run, "cls string, other string, cosine double")


def nearest(vectors: DataFrame, k: int = 5, least: float = -2.0, probes: int = PROBES, most_cells: int = MOST_CELLS, per_cell: int = PER_CELL, block: int = BLOCK) -> DataFrame:
    """id, neighbour, model, cosine, nth: the k most similar other records of the same model, nth from 1.

    vectors as of usable_vectors(). Only neighbours with a cosine of at least `least` come out. Equal cosines (to
    nine places) go to the smaller id. Records with the same vector are searched once and get their answers from
    their class. An empty table gives an empty result. Each model has up to `most_cells` cells of about `per_cell`
    vectors; cells of more than `block` are parted into up to as many again.
    """
    spark = vectors.sparkSession
    vectors = cut(vectors.withColumn("cls", F.hex(F.xxhash64("model", "vec"))))
    # Of the records with one vector, the first k + 1 can be among anyone's answers; the class is searched once.
    nth = F.row_number().over(W.partitionBy("cls").orderBy("id"))
    heads = vectors.select("cls", "id").withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("cls").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = cut(vectors.select("cls", "model", "vec").dropDuplicates(["cls"]))
    shared = spark.sparkContext.broadcast(fit_cells(classes, most_cells, per_cell))
    homes, routed = cut(_route(classes, shared, 1)), _route(classes, shared, probes)
    large = cut(homes.groupBy("model", "cell").agg(F.count("*").alias("n")).where(F.col("n") > block))  # at most a row per centroid
    index, queries = homes.withColumn("sub", F.lit(0)), routed.withColumn("sub", F.lit(0))
    if not large.isEmpty():
        cents = cut(_fit_parts(homes, large, per_cell, most_cells))

        def parted(df: DataFrame, to: int) -> DataFrame:
            small = df.join(large, ["model", "cell"], "left_anti")
            return cut(small.select("cls", "model", "cell", F.lit(0).alias("sub"), "vec").unionByName(_part(df, large, cents, to)))

        index, queries = parted(homes, 1), parted(routed, PARTS)
    pairs = _search(queries, index, k + 1, least, block)
    # Every answer of a class: its own records (cosine 1) and the heads of the others.
    best = pairs.join(heads.select(F.col("cls").alias("other"), "ids"), "other")
    best = best.select("cls", "cosine", F.explode("ids").alias("neighbour"))
    want = k + 1
    rank = F.row_number().over(W.partitionBy("cls").orderBy(F.desc("cosine"), "neighbour"))
    best = best.withColumn("place", rank).where(F.col("place") <= want)
    answers = best.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("place", "neighbour", "cosine"))).alias("found"))
    # A class may hold a third of all records: its answers are copied to as many salts.
    salts = 16
    salted = answers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = vectors.select("id", "model", "cls", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    mine = own.join(salted, ["cls", "salt"]).select("id", "model", F.slice(F.filter("found", lambda s: s["neighbour"] != F.col("id")), 1, k).alias("found"))
    return mine.select("id", "model", F.posexplode("found").alias("nth", "f")).select("id", F.col("f.neighbour").alias("neighbour"), "model", F.col("f.cosine").alias("cosine"), (F.col("nth") + 1).alias("nth"))


def recall(vectors: DataFrame, found: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """model, n_queries, n_true, n_found, recall of nearest() against brute force, for the queries against all rows.

    A neighbour counts as found if it is at least as similar (to six places) as the k-th of brute force.
    """
    from ..operators.semantic import similar

    truth = None
    for m in [r[0] for r in vectors.select("model").distinct().orderBy("model").collect()]:
        mine = vectors.where(F.col("model") == m).select("id", "vec")
        t = similar(mine, mine.where(queries), k, -2.0, "id", "vec").groupBy("query").agg(F.count("*").alias("n"), F.min("cosine").alias("least"))
        t = t.select(F.lit(m).alias("model"), F.col("query").alias("id"), "n", "least")
        truth = t if truth is None else truth.unionByName(t)
    if truth is None:
        return vectors.sparkSession.createDataFrame([], "model string, n_queries long, n_true long, n_found long, recall double")
    truth = cut(truth)
    hit = found.join(truth, ["model", "id"]).where(F.round("cosine", 6) >= F.col("least") - 1e-6).groupBy("model").agg(F.count("*").alias("n_found"))
    total = truth.groupBy("model").agg(F.count("*").alias("n_queries"), F.sum("n").alias("n_true"))
    n = F.coalesce("n_found", F.lit(0))
    return total.join(hit, "model", "left").select("model", "n_queries", "n_true", n.alias("n_found"), F.round(n / F.col("n_true"), 4).alias("recall"))


def similar_pairs(found: DataFrame, least: float) -> DataFrame:
    """id_a < id_b: pairs of which at least one is an answer of the other."""
    near = found.where(F.col("cosine") >= least)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
