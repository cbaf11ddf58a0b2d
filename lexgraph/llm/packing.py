"""Filling fixed-capacity containers: distributed packing with a swap-based local search.

Items are spread over shards of bounded size by a hash. Each shard starts from best fit by decreasing size; then
underfull containers exchange items - a move, one for one, two for one - whenever this raises the sum of squared
fills, until containers empty. What is left in clearly underfull containers goes to the next level, where the rests of
many shards are packed together in shards of the same size. Levels end when a bound shows that nothing can improve,
when a level leaves more than half of its items, or with the first level of one shard.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, shuffle_width

#: Items of a shard, on average.
SHARD = 4000
#: Containers filled less than this share are packed again with those of other shards.
GOOD = 0.98


def least_containers(counts: dict[int, int], capacity: int) -> int:
    """A lower bound of the containers that items need, from the number of items of each size.

    The largest of: the total over the capacity; for each k, the items of which a container can hold at most k; and for
    each threshold below the half, the large items, one a container, and what the middling ones need beyond the room
    that the large ones leave.
    """
    sizes = sorted(counts, reverse=True)
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    many, k = 0, 1
    for s in sizes:
        while s * (k + 1) <= capacity:
            best = max(best, -(-many // k))
            k += 1
        many += counts[s]
    best = max(best, -(-many // k))
    half = sum(n for s, n in counts.items() if 2 * s > capacity)
    for low in [s for s in sizes if 2 * s <= capacity]:
        room = sum((capacity - s) * n for s, n in counts.items() if capacity - low >= s and 2 * s > capacity)
        middling = sum(s * n for s, n in counts.items() if 2 * s <= capacity and s >= low)
        best = max(best, half + max(0, -(-(middling - room) // capacity)))
    return best


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit by decreasing size: the indexes of the items in each container."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (room, container), sorted
    for i in order:
        k = bisect_left(free, (sizes[i], -1))
        if k < len(free):
            room, b = free.pop(k)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > sizes[i]:
            insort(free, (room - sizes[i], b))
    return bins


def _exchange(item: int, values: tuple[int, ...], room: int) -> tuple[int, tuple[int, ...]]:
    """What a container of the sizes `values` (in order) gains by taking an item, and the sizes it hands back."""
    if room >= item:
        return item, ()
    # It hands back one or two smaller items so that it ends as full as possible.
    least = item - room
    gain, back = 0, ()
    k = bisect_left(values, least)
    if k < len(values) and values[k] < item:
        gain, back = item - values[k], (values[k],)
    for x in range(len(values)):
        if 2 * values[x] >= item:
            break
        y = bisect_left(values, least - values[x], x + 1)
        if y < len(values) and values[x] + values[y] < item and item - values[x] - values[y] > gain:
            gain, back = item - values[x] - values[y], (values[x], values[y])
    return gain, back


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Moves and exchanges between underfull containers that raise the sum of squared fills; empties what it can.

    It ends when the number of containers is the least possible or no exchange raises the sum, which can't go on for
    ever. Containers with the same sizes in them are alike: one of each kind is tried.
    """
    lowest = least_containers(Counter(sizes[i] for b in bins for i in b), capacity)
    number = len(bins)
    sums = [sum(sizes[i] for i in b) for b in bins]
    full = [b for b, f in zip(bins, sums) if f == capacity]
    kinds: dict[tuple[int, ...], list[list[int]]] = {}
    for b, f in zip(bins, sums):
        if f < capacity:
            kinds.setdefault(tuple(sorted(sizes[i] for i in b)), []).append(b)
    fill = {k: sum(k) for k in kinds}
    stuck: set[tuple[int, ...]] = set()

    def put(b: list[int]) -> None:
        k = tuple(sorted(sizes[i] for i in b))
        f = sum(k)
        if f == capacity:
            full.append(b)
        elif k:
            kinds.setdefault(k, []).append(b)
            fill[k] = f

    while number > lowest:
        # The emptiest container gives: every change takes size from it, which raises the sum of squares as long as
        # the receiver is fuller.
        donor = min((k for k in kinds if k not in stuck), key=lambda k: (fill[k], k), default=None)
        if donor is None:
            break
        best = None
        for item in sorted(set(donor), reverse=True):
            for taker in kinds:
                if fill[taker] < fill[donor] or taker == donor and len(kinds[donor]) < 2:
                    continue
                gain, back = _exchange(item, taker, capacity - fill[taker])
                if gain > 0:
                    # Raise of the sum of squares by shifting `gain` from donor to taker.
                    key = (gain * (gain + fill[taker] - fill[donor]), taker)
                    if best is None or key > best[0]:
                        best = (key, taker, item, back)
            if best is not None:
                break
        if best is None:
            stuck.add(donor)
            continue
        _, taker, item, back = best
        giver, receiver = kinds[donor].pop(), kinds[taker].pop()
        for k in {donor, taker}:
            if not kinds[k]:
                del kinds[k]
        moved = next(i for i in giver if sizes[i] == item)
        giver.remove(moved)
        receiver.append(moved)
        for s in back:
            x = next(i for i in receiver if sizes[i] == s and i != moved)
            receiver.remove(x)
            giver.append(x)
        number -= not giver
        put(giver)
        put(receiver)
        stuck.clear()
    return full + [b for bs in kinds.values() for b in bs]


def _pack_level(items: DataFrame, level: int, shards: int, capacity: int, last: bool) -> DataFrame:
    """item columns, shard, container_id or else tentative: the container of a part that may be packed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(shard: int, t: pa.Table) -> pa.RecordBatch:
            sizes = t.column("n_tokens").to_pylist()
            name: list[str | None] = [None] * len(sizes)
            open_: list[str | None] = [None] * len(sizes)
            for k, b in enumerate(local_search(best_fit(sizes, capacity), sizes, capacity)):
                names = name if last or sum(sizes[i] for i in b) >= GOOD * capacity else open_
                for i in b:
                    names[i] = f"{level}-{shard}-{k}"
            t = t.append_column("container_id", pa.array(name, pa.string())).append_column("tentative", pa.array(open_, pa.string())).combine_chunks()
            return t.to_batches()[0]

        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = (t if rest is None else pa.concat_tables([rest, t])).combine_chunks()
            s = t.column("shard").to_numpy()
            ends = [*(np.flatnonzero(s[1:] != s[:-1]) + 1)]
            low = 0
            for e in ends:
                yield pack(int(s[low]), t.slice(low, e - low))
                low = e
            rest = t.slice(low)
        if rest is not None and rest.num_rows:
            yield pack(rest.column("shard")[0].as_py(), rest)

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in items.schema.fields)}, container_id string, tentative string"
    # Shards keep to their own tasks: adaptive execution would merge them by their few bytes.
    parts = min(shards, max(4 * shuffle_width(items.sparkSession), -(-shards // 50)))
    return items.repartition(parts, "shard").sortWithinPartitions("shard", "n_tokens", "doc_id", "part_no").mapInArrow(run, schema)


def pack(items: DataFrame, capacity: int = 2048, key: str = "doc_id", size: str = "n_tokens", shard: int = SHARD) -> DataFrame:
    """container_id, doc_id, part_no, start_token, n_tokens: where each part of each item goes.

    No container holds more than `capacity`. An item is split only if it is larger: into full containers (part 1 ...)
    and its rest. Items of size 0 or null take no space and give no rows. A repeated row is packed once for every
    time it occurs. Other columns are ignored; an empty table gives an empty result. No task packs much more than
    `shard` parts at a time.
    """
    rows = items.select(F.col(key).alias("doc_id"), F.col(size).cast("long").alias("_size")).where("_size > 0")
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_size") / F.lit(capacity)) - 1), lambda k: F.struct((k + 1).cast("int").alias("part_no"), (k * capacity).alias("start_token"), F.least(F.lit(capacity).cast("long"), F.col("_size") - k * capacity).alias("n_tokens")))
    # An id for each row, so that many copies of one key spread over the shards.
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_p", F.explode(parts)).select("doc_id", "_row", "_p.part_no", "_p.start_token", "_p.n_tokens"))
    whole = rows.where(F.col("n_tokens") == capacity)
    full = whole.select(F.concat(F.lit("f-"), F.col("_row").cast("string"), F.lit("-"), F.col("part_no").cast("string")).alias("container_id"), "doc_id", "part_no", "start_token", "n_tokens")
    rest = rows.where(F.col("n_tokens") < capacity)
    done, level, count = [full], 0, rest.count()
    last = count <= shard
    while True:
        shards = max(1, -(-count // shard))
        packed = cut(_pack_level(rest.withColumn("shard", F.pmod(F.xxhash64(F.lit(level), "doc_id", "_row", "part_no"), F.lit(shards))), level, shards, capacity, last))
        done.append(packed.where("container_id is not null").select("container_id", "doc_id", "part_no", "start_token", "n_tokens"))
        if last:
            break
        rest = packed.where("container_id is null")
        sizes = {r["n_tokens"]: r["n"] for r in rest.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most one row per size below the capacity
        used = rest.select("tentative").distinct().count()
        left = sum(sizes.values())
        if used <= least_containers(sizes, capacity) or 2 * left > count and left > shard:
            done.append(rest.select(F.col("tentative").alias("container_id"), "doc_id", "part_no", "start_token", "n_tokens"))
            break
        rest, count, level, last = rest.select("doc_id", "_row", "part_no", "start_token", "n_tokens"), left, level + 1, left <= shard
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, the least possible number of containers, and the share of space used."""
    total = packed.agg(F.countDistinct("container_id").alias("n_containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    least = F.ceil(F.col("n_tokens") / F.lit(capacity)).cast("long")
    return total.select("n_containers", "n_tokens", least.alias("least_containers"), F.round(F.col("n_tokens") / F.greatest(F.col("n_containers") * capacity, F.lit(1)), 6).alias("fill"))
