"""Near-duplicate records: an exact set-similarity join that skips by the relations between sets.

Sets are ordered by rare words first. Index lists of the words in each set's prefix are cut into blocks by set size
and position, and a pair of blocks is skipped when no pair in it can reach the overlap it needs; what is left is
compared by the bit-parity signatures of the sets, whose distance is a lower bound of the sets' difference. Copies of
a set, and sets that differ from it in their rarest word only, aren't searched: their answers are derived from those
of the leader of their family, which is searched with the slack that the difference makes.

Long lists are parted by bands of set size, and words with very long ones have none: two sets whose first common word
is such a word have a second one in their prefixes too. Sets with two such words in their prefixes are compared all with
all, in blocks of similar size; which words have lists is chosen by what either costs. Lists, blocks and the words of
candidate pairs are shuffled in rounds, each freed before the next, so that the disk needed follows the input.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, discard, freed_shuffles, gathered, shuffle_width

#: Similarity of the join, as an exact fraction; words and characters that a text must have to take part.
SIMILARITY, LEAST_WORDS, MOST_CHARS = Fraction(7, 10), 30, 1800
#: Counters of the sketches of list lengths: a proven bound on what is broadcast (4 MB).
COUNTERS = 1 << 18
#: Most entries of an index list that one group compares; longer lists are cut into chunks compared pairwise.
CHUNK = 4096
#: Words in more sets than this have no list.
LONG = 32 * CHUNK
#: Most sets in a block, and fewest blocks that many sets are cut into.
BLOCK, BLOCKS = 1 << 18, 8
#: Rows shuffled at once: so many a set, or if there are few sets so many; candidate pairs whose words are, a set.
ROUND_ROWS, LEAST_ROUND, ROUND_PAIRS = 4, 1 << 20, 0.5
#: A shuffled row costs as much as so many comparisons.
ROW_COST = 2000
#: Sets with fewer words keep the lists of all words: they may have one word in common only.
SMALL = 16
#: Rows of a list compared at once, and with how many; distances from which half of a signature tells too little.
ROWS, COLUMNS, FAR = 16, 4096, 38

_WORD = re.compile(r"[^\W_]+").findall


class _Hashes(dict):
    """Signed 64-bit hash of a word."""

    def __missing__(self, w: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        v = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        got = self[w] = v - (1 << 64) if v >= 1 << 63 else v
        return got


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A list key from two hashes or a hash and a number."""
    x = a.view(np.uint64) * _A ^ (b.astype(np.int64).view(np.uint64) + np.uint64(1)) * _B
    return (x ^ x >> np.uint64(29)).view(np.int64)


def _edges(t: Fraction = SIMILARITY, most: int = 1 << 20) -> np.ndarray:
    """Least sizes of the bands: a set's partner of at most its size is in its own band or the one below."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, (out[-1] - 1) * t.denominator // t.numerator + 1))
    return np.array(out)


_BANDS = _edges()


def _counter(h: np.ndarray) -> np.ndarray:
    return (h & (COUNTERS - 1)).astype(np.int64)


def word_sets(df: DataFrame) -> DataFrame:
    """id, words (sorted hashes), same (key of equal sets), copy (key of equal title and text) of df(id, at, title, text).

    One row for each record that takes part: of several deliveries the latest counts, then the greater copy key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = _Hashes()
        for b in batches:
            sets, same, copies = [], [], []
            for title, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = ()
                if text is not None and len(text) <= MOST_CHARS and len(text.split()) >= LEAST_WORDS:
                    words = set(_WORD(f"{title or ''} {text}".lower()))
                if words:
                    h = np.fromiter(map(hashes.__getitem__, words), np.int64, len(words))
                    h.sort()
                    sets.append(h)
                    same.append(xxhash.xxh3_128_digest(h.tobytes()))
                else:
                    sets.append(None)
                    same.append(None)
                copies.append(xxhash.xxh3_128_digest(f"{'' if title is None else len(title)}:{title or ''}{text}".encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.list_(pa.int64())), pa.array(same, pa.binary()), pa.array(copies, pa.binary())], ["id", "at", "words", "same", "copy"])

    kind = df.schema["at"].dataType.simpleString()
    made = df.select("id", "at", "title", "text").mapInArrow(run, f"id string, at {kind}, words array<long>, same binary, copy binary")
    last = made.groupBy("id").agg(F.max_by(F.struct("words", "same", "copy"), F.struct("at", "copy")).alias("r"))
    return last.where("r.words is not null").select("id", "r.words", "r.same", "r.copy")


def list_lengths(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the lengths of lists, over all sets: by word, and by word and band of size. Never less than the truth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * COUNTERS, np.int64)
        for b in batches:
            words = b.column(0)
            flat = words.flatten().to_numpy(zero_copy_only=False)
            if not len(flat):
                continue
            n = np.diff(words.offsets.to_numpy().astype(np.int64))
            band = np.repeat(np.searchsorted(_BANDS, n, "right"), n)
            total[:COUNTERS] += np.bincount(_counter(flat), minlength=COUNTERS)
            for k in (0, 1):
                total[COUNTERS:] += np.bincount(_counter(_mix(flat, band - k)), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["counter", "n"])

    got = sets.select("words").mapInArrow(run, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()  # at most one row per counter
    out = np.zeros(2 * COUNTERS, np.int64)
    out[got["counter"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out[:COUNTERS], out[COUNTERS:]


def in_order(reps: DataFrame, counts) -> DataFrame:
    """id, same, n, words (rare first), s0 to s3 (signature), core (key of the set without its rarest word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        freq = counts.value[0]
        for b in batches:
            if not b.num_rows:
                continue
            words = b.column("words")
            flat, ends = words.values.to_numpy(zero_copy_only=False), words.offsets.to_numpy().astype(np.int64)
            n, out, marks, core = np.diff(ends), [], np.zeros((b.num_rows, 4), np.uint64), []
            for k in range(b.num_rows):
                h = flat[ends[k] : ends[k + 1]]
                h = h[np.lexsort((h, freq[_counter(h)]))]
                out.append(h)
                bit = (h.view(np.uint64) >> np.uint64(20)) & np.uint64(255)
                bits = np.bincount(bit.astype(np.int64), minlength=256).astype(np.uint64) & np.uint64(1)
                marks[k] = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)
                core.append(xxhash.xxh3_128_digest(np.sort(h[1:]).tobytes()))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(out)))
            signs = marks.view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("same"), pa.array(n.astype(np.int32)), lists, *(pa.array(signs[:, j].copy()) for j in range(4)), pa.array(core, pa.binary())], ["id", "same", "n", "words", "s0", "s1", "s2", "s3", "core"])

    return reps.select("id", "same", "words").mapInArrow(run, "id string, same binary, n int, words array<long>, s0 long, s1 long, s2 long, s3 long, core binary")


def _need(total: np.ndarray | int, t: Fraction = SIMILARITY):
    """Least overlap of two sets with `total` elements together."""
    a, b = t.numerator, t.numerator + t.denominator
    return -(-(total * a) // b)


_ENTRY = "word long, part long, n int, pos int, slack int, own int, index boolean, key long, s0 long, s1 long, s2 long, s3 long"


def _prefixes(n: np.ndarray, slack: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """How many words of each set are looked up, and how many of those also stand in lists."""
    num, den = t.numerator, t.denominator
    # A partner is at least t * n large; one element of slack may be its own as well.
    probe = np.minimum(n, n - -(-(n * num) // den) + 1 + slack + 1)
    index = np.minimum(n, n - -(-(2 * n * num) // (num + den)) + 1 + slack + 1)
    return probe, index


def _postings(leaders: DataFrame, counts, long: int, turn: int = 0, rounds: int = 1, t: Fraction = SIMILARITY) -> DataFrame:
    """One row per word of each leader's prefix (times the bands and chunks that a long list needs); of one round's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, banded = counts.value
        names = ["word", "part", "n", "pos", "slack", "own", "index", "key", "s0", "s1", "s2", "s3"]
        for b in batches:
            if not b.num_rows:
                continue
            n, slack, key = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "slack", "key"))
            words = b.column("words")
            flat, start = words.values.to_numpy(zero_copy_only=False), words.offsets.to_numpy().astype(np.int64)[:-1]
            probe, index = _prefixes(n, slack, t)
            row = np.repeat(np.arange(len(n)), probe)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(probe) - probe, probe)
            word = flat[start[row] + pos]
            f = freq[_counter(word)]
            own_list = ((f <= long) | (n[row] < SMALL)) & ((word.view(np.uint64) >> np.uint64(40)) % np.uint64(rounds) == turn)
            row, pos, word, f = row[own_list], pos[own_list], word[own_list], f[own_list]
            indexed = pos < index[row]
            band = np.searchsorted(_BANDS, n, "right")
            parted = f > CHUNK
            # A short list is one; of a long one there is a list for each band, and larger sets look into the band below.
            at = np.concatenate([np.flatnonzero(~parted), np.flatnonzero(parted), np.flatnonzero(parted)])
            below = np.concatenate([np.zeros(len(row) - parted.sum(), np.int64), np.zeros(parted.sum(), np.int64), np.ones(parted.sum(), np.int64)])
            row, pos, word, parted = row[at], pos[at], word[at], parted[at]
            indexed = indexed[at] & (below == 0)
            word = np.where(parted, _mix(word, band[row] - below), word)
            times = np.where(parted, np.maximum(-(-banded[_counter(word)] // CHUNK), 1), 1)
            own = (key[row].view(np.uint64) % times.astype(np.uint64)).astype(np.int64)
            at = np.repeat(np.arange(len(row)), times)
            other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            low, high = np.minimum(own[at], other), np.maximum(own[at], other)
            r = row[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(word[at]), pa.array(low * times[at] + high), pa.array(n[r].astype(np.int32)), pa.array(pos[at].astype(np.int32)), pa.array(slack[r].astype(np.int32)), pa.array(own[at].astype(np.int32)), pa.array(indexed[at]), pa.array(key[r]), *(b.column(f"s{j}").take(pa.array(r)) for j in range(4))],
                names,
            )

    return leaders.select("n", "slack", "key", "words", "s0", "s1", "s2", "s3").mapInArrow(run, _ENTRY)


def _often(words: np.ndarray, start: np.ndarray, n: np.ndarray, probe: np.ndarray, freq: np.ndarray, long: int) -> np.ndarray:
    """How many words without a list stand in each set's prefix, which is longer by one word."""
    upto = np.minimum(n, probe + 1)
    row = np.repeat(np.arange(len(n)), upto)
    h = words[start[row] + np.arange(len(row)) - np.repeat(np.cumsum(upto) - upto, upto)]
    return np.bincount(row, freq[_counter(h)] > long, minlength=len(n))


@dataclass
class Course:
    """How the leaders are compared: words in at most `long` sets have lists, shuffled in so many rounds; sizes: how many leaders of each number of words have two other words in their prefix, they are compared in blocks."""

    long: int
    rounds: int
    sizes: dict[int, int]


def _course(leaders: DataFrame, counts, long: int | None, t: Fraction = SIMILARITY) -> Course:
    """The cheapest limit of list lengths (or the given one). Costs no more to find than a pass over the leaders."""
    limits = [0, CHUNK, 4 * CHUNK, LONG] if long is None else [long]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = counts.value[0]
        total, small = np.zeros(COUNTERS, np.int64), np.zeros(COUNTERS, np.int64)
        sizes: dict[tuple[int, int], int] = {}
        for b in batches:
            if not b.num_rows:
                continue
            n, slack = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "slack"))
            words = b.column("words")
            flat, start = words.values.to_numpy(zero_copy_only=False), words.offsets.to_numpy().astype(np.int64)[:-1]
            probe, _ = _prefixes(n, slack, t)
            row = np.repeat(np.arange(len(n)), probe)
            at = _counter(flat[start[row] + np.arange(len(row)) - np.repeat(np.cumsum(probe) - probe, probe)])
            total += np.bincount(at, minlength=COUNTERS)
            small += np.bincount(at[n[row] < SMALL], minlength=COUNTERS)
            for k, limit in enumerate(limits):
                for size, c in zip(*np.unique(n[_often(flat, start, n, probe, freq, limit) > 1], return_counts=True)):
                    sizes[k, int(size)] = sizes.get((k, int(size)), 0) + int(c)
        for kind, x in ((-2, total), (-1, small)):
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(x[at])], ["kind", "at", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sizes], pa.int32()), pa.array([x for _, x in sizes], pa.int32()), pa.array([*sizes.values()], pa.int64())], ["kind", "at", "n"])

    got = leaders.select("n", "slack", "words").mapInArrow(run, "kind int, at int, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).toPandas()  # at most two rows per counter and one per number of words
    freq, leaders_n = counts.value[0], leaders.count()
    total, small = (np.zeros(COUNTERS, np.int64) for _ in range(2))
    for kind, x in ((-2, total), (-1, small)):
        own = got[got["kind"] == kind]
        x[own["at"].to_numpy(np.int64)] = own["n"].to_numpy(np.int64)
    out = []
    for k, limit in enumerate(limits):
        own = got[got["kind"] == k]
        sizes = dict(zip(own["at"].tolist(), own["n"].tolist()))
        m = sum(sizes.values())
        listed = np.where(freq <= limit, total, small).astype(float)
        rows = (listed * np.where(freq > CHUNK, 2 * np.ceil(freq / CHUNK), 1)).sum()
        blocks = len(_block_pairs(sizes)[1])
        cost = (listed**2).sum() / 2 + m * m / 2 + ROW_COST * (rows + 2 * blocks * m / max(1, _block_count(m)))
        out.append((cost, k, Course(limit, max(1, int(np.ceil(rows / max(LEAST_ROUND, ROUND_ROWS * leaders_n)))), sizes)))
    return min(out, key=lambda x: x[:2])[2]


def _block_count(m: int) -> int:
    return max(-(-m // BLOCK), min(BLOCKS, -(-m // 512)))


def _block_pairs(sizes: dict[int, int]) -> tuple[dict[int, tuple[int, int]], list[tuple[int, int]]]:
    """Where the sets of each size start among all and how many they are; pairs of blocks that may hold similar sets, the larger sets' second."""
    at, place = 0, {}
    for n in sorted(sizes):
        place[n] = (at, sizes[n])
        at += sizes[n]
    count = _block_count(at)
    least, most = [0] * count, [0] * count
    for n, (first, c) in place.items():
        for k in range(first * count // at, (first + c - 1) * count // at + 1):
            least[k] = least[k] or n
            most[k] = n
    return place, [(i, j) for j in range(count) for i in range(j + 1) if most[i] * SIMILARITY.denominator >= least[j] * SIMILARITY.numerator] if at else []


def _block_candidates(leaders: DataFrame, counts, course: Course, t: Fraction = SIMILARITY) -> Iterator[DataFrame]:
    """Pairs of leaders that the blocks leave, by round."""
    place, pairs = _block_pairs(course.sizes)
    m = sum(course.sizes.values())
    if m < 2:
        return
    count, long = _block_count(m), course.long
    top = max(place) + 1
    first, own = (np.zeros(top, np.int64) for _ in range(2))
    for n, (x, c) in place.items():
        first[n], own[n] = x, c
    each = max(1, int(max(LEAST_ROUND, ROUND_ROWS * m) * count / m / 2))

    def entries(of: list[tuple[int, int]]) -> Callable:
        by = [[k for k, p in enumerate(of) if x in p] for x in range(count)]
        times, start = np.array([len(x) for x in by]), np.cumsum([0, *(len(x) for x in by)])
        to = np.array([k for x in by for k in x], np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            freq = counts.value[0]
            for b in batches:
                if not b.num_rows:
                    continue
                n, slack, key = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "slack", "key"))
                words = b.column("words")
                probe, _ = _prefixes(n, slack, t)
                r = np.flatnonzero(_often(words.values.to_numpy(zero_copy_only=False), words.offsets.to_numpy().astype(np.int64)[:-1], n, probe, freq, long) > 1)
                # Sets of one size are spread over its blocks by their keys.
                inside = ((key[r].view(np.uint64) >> np.uint64(33)).astype(np.float64) / (1 << 31) * own[n[r]]).astype(np.int64)
                block = (first[n[r]] + np.minimum(inside, own[n[r]] - 1)) * count // m
                rep = np.repeat(np.arange(len(r)), times[block])
                turn = np.arange(len(rep)) - np.repeat(np.cumsum(times[block]) - times[block], times[block])
                at = pa.array(r[rep])
                yield pa.RecordBatch.from_arrays([pa.array(to[start[block[rep]] + turn].astype(np.int32)), pa.array(block[rep].astype(np.int32)), *(b.column(c).take(at) for c in ("n", "slack", "key", "s0", "s1", "s2", "s3"))], ["pair", "block", "n", "slack", "key", "s0", "s1", "s2", "s3"])

        return run

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition holds the two blocks of one pair."""
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        v = pa.Table.from_batches(got)
        pair, n, slack, block, key = (v.column(c).to_numpy().astype(np.int64) for c in ("pair", "n", "slack", "block", "key"))
        signs = np.stack([v.column(f"s{j}").to_numpy().view(np.uint64) for j in range(4)], axis=1)
        at = np.lexsort((key, n, block, pair))
        pair, block, values = pair[at], block[at], [c[at] for c in (n, slack, key, signs)]
        for p in np.unique(pair):
            own = np.flatnonzero(pair == p)
            low = block[own] == block[own[0]]
            y, x = own[low], own if low.all() else own[~low]
            others = [c[y] for c in values]
            for a in range(0, len(x), 128 * ROWS):
                found_a, found_b = _near(*(c[x[a : a + 128 * ROWS]] for c in values), *others)
                if len(found_a):
                    yield pa.RecordBatch.from_arrays([pa.array(found_a), pa.array(found_b)], ["a", "b"])

    cols = leaders.select("n", "slack", "key", "words", "s0", "s1", "s2", "s3")
    for k in range(0, len(pairs), each):
        of = pairs[k : k + each]
        made = cols.mapInArrow(entries(of), "pair int, block int, n int, slack int, key long, s0 long, s1 long, s2 long, s3 long")
        yield made.repartitionById(len(of), F.col("pair")).mapInArrow(compare, "a long, b long").distinct()


def _near(n, slack, key, signs, yn, yslack, ykey, ysigns) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one of the first sets and one of the others (both sorted by n) that is no larger, if they may be similar."""
    none = np.zeros(len(n), np.int64)
    return _compare(n, none, slack, none, None, key, signs, False, (yn, np.zeros(len(yn), np.int64), ysigns, None, yslack, ykey))


def _compare(n, pos, slack, own, index, key, signs, split: bool, others: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one list (sorted by n) that may be similar. split: only pairs between the list's two chunks. others: n, pos, signs, own, slack and key of the sets to compare with, in place of those of the list."""
    found_a, found_b = [], []
    if others is None:
        ys = np.flatnonzero(index)
        others = n[ys], pos[ys], signs[ys], own[ys], slack[ys], key[ys]
    yn, ypos, ysign, yown, yslack, ykey = others
    if not len(yn):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = own.min() != own.max()
    columns = [np.ascontiguousarray(ysign[:, j]) for j in range(4)]
    limits = np.minimum(2 * n - 2 * _need(2 * n) + 2 * slack + 2 + 2, 255).astype(np.uint8)
    for a in range(0, len(n), ROWS):
        b = min(a + ROWS, len(n))
        most = n[a:b].max()
        # Blocks of the list whose sets are too small are passed over, and so are those too far back in their sets.
        low = np.searchsorted(yn, (SIMILARITY.numerator * n[a]) // SIMILARITY.denominator - 3)
        high = np.searchsorted(yn, most, "right")
        for c in range(low, high, COLUMNS):
            d = min(c + COLUMNS, high)
            least = _need(int(n[a]) + int(yn[c])) - 2
            if 1 + min(most - pos[a:b].min() - 1, yn[c:d].max() - ypos[c:d].min() - 1) < least:
                continue
            x, y = signs[a:b], ysign[c:d]
            # Of long signatures all bits are counted at once; a sum of 256 is taken for 0, which keeps the pair.
            far = np.bitwise_count(x[:, None, 0] ^ columns[0][None, c:d])
            for k in range(1, 4 if limits[b - 1] > FAR else 2):
                far += np.bitwise_count(x[:, None, k] ^ columns[k][None, c:d])
            hit = far <= limits[a:b, None]
            if not hit.any():
                continue
            i, j = np.nonzero(hit)
            far = np.bitwise_count(x[i] ^ y[j]).sum(axis=1, dtype=np.int64)
            total = n[a + i] + yn[c + j]
            need = _need(total) - slack[a + i] - yslack[c + j]
            reach = 1 + np.minimum(n[a + i] - pos[a + i] - 1, yn[c + j] - ypos[c + j] - 1)
            ok = (far <= total - 2 * need) & (reach >= need) & (key[a + i] != ykey[c + j])
            if split and two:
                ok &= own[a + i] != yown[c + j]
            if ok.any():
                found_a.append(key[a + i[ok]])
                found_b.append(ykey[c + j[ok]])
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    return np.minimum(a, b), np.maximum(a, b)


def _candidates(postings: DataFrame) -> DataFrame:
    """Pairs of leaders (a < b by key) that the lists leave."""
    cols = ["n", "pos", "slack", "own"]

    def groups(batches: Iterator[pa.RecordBatch]):
        """Whole lists, which may go over the ends of batches; a list's part is bounded by two chunks."""
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            t = t.combine_chunks()
            w, p = t.column("word").to_numpy(), t.column("part").to_numpy()
            edge = np.flatnonzero((w[1:] != w[:-1]) | (p[1:] != p[:-1])) + 1
            starts = np.concatenate([[0], edge])
            if len(starts) > 1:
                yield t, starts[:-1], starts[1:]
            rest = t.slice(starts[-1])
        if rest is not None and rest.num_rows:
            yield rest, np.array([0]), np.array([rest.num_rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts, ends in groups(b for b in batches if b.num_rows):
            v = {c: t.column(c).to_numpy().astype(np.int64) for c in cols}
            key, index = t.column("key").to_numpy(), t.column("index").to_numpy()
            signs = np.stack([t.column(f"s{j}").to_numpy().view(np.uint64) for j in range(4)], axis=1)
            out_a, out_b = [], []
            for s, e in zip(starts, ends):
                if e - s > 1:
                    a, b = _compare(*(v[c][s:e] for c in cols), index[s:e], key[s:e], signs[s:e], True)
                    if len(a):
                        out_a.append(a)
                        out_b.append(b)
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    parts = max(shuffle_width(postings.sparkSession), 1)
    lists = postings.repartition(parts, "word", "part").sortWithinPartitions("word", "part", "n", "key")
    return lists.mapInArrow(run, "a long, b long").distinct()


@dataclass
class Found:
    """What the join finds.

    members: id, rep, copy - each record that takes part, the first record (smallest id) with the same set of words,
    and a key of equal title and text. sets: rep, key, leader, family, n - each different set with its family, the
    family's size and the set's number of words. links: rep_a < rep_b - similar sets of different families. The sets
    of a family differ in one word each, so they are all similar to each other, or with too few words none.
    """

    members: DataFrame
    sets: DataFrame
    links: DataFrame

    def families(self) -> DataFrame:
        """The sets of families of two or more whose members are similar to each other."""
        n = F.col("n")
        return self.sets.where((F.col("family") > 1) & ((n - 1) * SIMILARITY.denominator >= (n + 1) * SIMILARITY.numerator))


def near_duplicate_sets(src: DataFrame, long: int | None = None) -> Found:
    """Classes and links of the records in src(id, at, title, text). No link is lost. long: words in more sets have no list."""
    with freed_shuffles(src.sparkSession):
        return _sets(src, long)


def _sets(src: DataFrame, long: int | None) -> Found:
    spark = src.sparkSession
    sets = cut(word_sets(src))
    lengths = list_lengths(sets)
    counts = spark.sparkContext.broadcast(lengths)
    classes = sets.groupBy("same").agg(F.min("id").alias("rep"))
    members = cut(sets.select("id", "same", "copy").join(classes, "same").select("id", "rep", "copy"))
    first = sets.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")
    ordered = cut(in_order(first, counts).withColumn("key", F.xxhash64("same")).drop("same"))
    discard(sets)
    families = ordered.groupBy("core").agg(F.min("key").alias("leader"), F.count("*").alias("family"))
    reps = cut(ordered.join(families, "core").drop("core"))
    discard(ordered)
    family = cut(reps.select(F.col("id").alias("rep"), "key", "leader", "family", "n"))
    leaders = reps.where("key = leader").withColumn("slack", F.when(F.col("family") > 1, 1).otherwise(0))
    course = _course(leaders, counts, long)
    rounds = (_candidates(_postings(leaders, counts, course.long, k, course.rounds)) for k in range(course.rounds))
    once = gathered(chain(rounds, _block_candidates(leaders, counts, course)))
    near = cut(once.distinct())
    discard(once)
    links = gathered(_verified(near, family, reps))
    discard(near)
    discard(reps)
    return Found(members, family, links)


def _verified(near: DataFrame, family: DataFrame, reps: DataFrame) -> Iterator[DataFrame]:
    """rep_a < rep_b, by round: of the leaders' answers (with their slack) for each member of their families those that are similar."""
    keys = near.select(F.col("a").alias("leader")).unionByName(near.select(F.col("b").alias("leader")))
    words = cut(reps.select("key", "leader", "id", "words", "n").join(keys, "leader", "left_semi"))
    size = family.where("key = leader").select("leader", "family")
    total = near.join(size.toDF("a", "fa"), "a").join(size.toDF("b", "fb"), "b").agg(F.sum(F.col("fa") * F.col("fb"))).first()[0] or 0
    rounds = max(1, -int(-total // max(LEAST_ROUND, ROUND_PAIRS * family.count())))
    all_of = words.select("key", "leader")
    a, b = (words.select(*(F.col(c).alias(f"{x}_{c}") for c in ("key", "id", "words", "n"))) for x in "ab")
    for k in range(rounds):
        # Members of large families are parted too, so a round is not more than its share.
        found = near.join(all_of.toDF("ka", "a"), "a").join(all_of.toDF("kb", "b"), "b").select("ka", "kb")
        if rounds > 1:
            found = found.where(F.pmod(F.xxhash64("ka", "kb"), F.lit(rounds)) == k)
        joined = found.join(a, F.col("ka") == F.col("a_key")).join(b, F.col("kb") == F.col("b_key"))
        common = F.size(F.array_intersect("a_words", "b_words"))
        alike = common * SIMILARITY.denominator >= (F.col("a_n") + F.col("b_n") - common) * SIMILARITY.numerator
        yield joined.where(alike).select(F.least("a_id", "b_id").alias("rep_a"), F.greatest("a_id", "b_id").alias("rep_b"))
    discard(words)


def prepare(df: DataFrame, key: str = "id", title: str = "title", text: str = "text", loaded: str | None = "loaded_at") -> DataFrame:
    """id, at, title, text of each delivery; records without an id don't take part."""
    at = F.col(loaded) if loaded else F.lit(0)
    return df.select(F.col(key).cast("string").alias("id"), at.alias("at"), F.col(title).alias("title"), F.col(text).alias("text")).where("id is not null")


def near_duplicate_pairs(df: DataFrame, key: str = "id", title: str = "title", text: str = "text", loaded: str | None = "loaded_at", long: int | None = None) -> DataFrame:
    """id_a < id_b: all pairs of records whose word sets are similar by 0.7 or more, exact copies too.

    Records without an id, with null or empty text, with fewer than 30 words or more than 1,800 characters don't take
    part; of several deliveries of one id the latest counts. Other columns are ignored. The number of pairs is
    quadratic in the size of a group of copies; near_duplicate_classes gives the same answer in one row per record.
    """
    found = near_duplicate_sets(prepare(df, key, title, text, loaded), long)
    m = found.members.select("rep", "id")
    own = found.families().select("leader", "rep")
    inside = own.toDF("leader", "rep_a").join(own.toDF("leader", "rep_b"), "leader").where("rep_a < rep_b").select("rep_a", "rep_b")
    with freed_shuffles(df.sparkSession):
        links = cut(found.links.unionByName(inside))  # a join right above a union fails to plan when the union's parts are coalesced differently
    across = links.join(m.toDF("rep_a", "x"), "rep_a").join(m.toDF("rep_b", "y"), "rep_b").select("x", "y")
    within = m.toDF("rep", "x").join(m.toDF("rep", "y"), "rep").where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_duplicate_classes(df: DataFrame, key: str = "id", title: str = "title", text: str = "text", loaded: str | None = "loaded_at", long: int | None = None) -> DataFrame:
    """id, class_id, n_same, n_links: one row per record that takes part, in place of its pairs.

    class_id is the smallest id with the same set of words, n_same the number of records of that class, n_links the
    number of other records similar by 0.7 or more, those of the class included. Who takes part is as for
    near_duplicate_pairs. No pairs of equal sets or within a family are made.
    """
    found = near_duplicate_sets(prepare(df, key, title, text, loaded), long)
    size = found.members.groupBy("rep").agg(F.count("*").alias("n_same"))
    to = found.links.select(F.col("rep_a").alias("of"), F.col("rep_b").alias("rep")).unionByName(found.links.select(F.col("rep_b").alias("of"), F.col("rep_a").alias("rep")))
    across = cut(to).join(size, "rep").groupBy(F.col("of").alias("rep")).agg(F.sum("n_same").alias("across"))
    own = found.families().select("leader", "rep").join(size, "rep")
    total = own.groupBy("leader").agg(F.sum("n_same").alias("total"))
    inside = own.join(total, "leader").select("rep", (F.col("total") - F.col("n_same")).alias("inside"))
    sums = size.join(across, "rep", "left").join(inside, "rep", "left")
    n = F.col("n_same") - 1 + F.coalesce("across", F.lit(0)) + F.coalesce("inside", F.lit(0))
    return found.members.join(sums.select("rep", "n_same", n.alias("n_links")), "rep").select("id", F.col("rep").alias("class_id"), "n_same", "n_links")
