"""Noise of scanned pages: a noisy channel over the words of a line, and the furniture of pages.

Words, word pairs and title-like lines of all texts are counted exactly, in tables. Running headers and footers are
short title-like lines that interrupt sentences in many different surroundings. A text is repaired by dropping page
furniture, closing words cut at line ends or spaced out, and decoding each line with a Viterbi search over candidate
words: character confusion probabilities times the corpus likelihood of the words in their order.

A word and all its misreadings have one key, so what a word may have been meant to be is found among the words of its
key, once for each different word. A filter of fixed size tells which texts may have anything to repair; those ask for
the counts they need, which are joined to them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrowmap import add_columns
from ..runtime import cut

#: Bits of the filter of words and lines that may have to do with scanning: a proven bound on what is broadcast (1 MB).
#: What it lets through is looked up in the tables, so it changes no result.
BITS = 1 << 23
#: A word is known from this count on; a correction must be so many times as frequent as what was read.
KNOWN, ODDS = 8, 8
#: Different surroundings that make a repeated line a running header or footer; its longest length.
SURROUNDINGS, LONGEST = 3, 70

#: Confusions of characters, read -> meant, and their probabilities (fixed values).
CONFUSIONS = {
    "†": [("t", 0.2)], "|": [("i", 0.2), ("l", 0.1)], "1": [("l", 0.1), ("i", 0.05)], "0": [("o", 0.1)], "5": [("s", 0.1)],
    "8": [("b", 0.02)], "6": [("b", 0.02)], "9": [("g", 0.02)], "3": [("e", 0.01)], "$": [("s", 0.1)], "€": [("e", 0.05)], "¢": [("c", 0.1)],
    "ﬁ": [("fi", 0.3)], "ﬂ": [("fl", 0.3)], "ﬀ": [("ff", 0.3)], "ﬃ": [("ffi", 0.3)], "ﬄ": [("ffl", 0.3)],
    "c": [("e", 0.02)], "e": [("c", 0.005)], "rn": [("m", 0.02)], "m": [("rn", 0.005)], "cl": [("d", 0.02)], "d": [("cl", 0.005)],
    "li": [("h", 0.02)], "h": [("li", 0.01)], "ii": [("u", 0.02)], "vv": [("w", 0.02)],
}
#: What each character is written as in a word's key, so that a word and all its misreadings have the same key.
_KEY = str.maketrans({"†": "t", "|": "i", "1": "i", "l": "i", "0": "o", "5": "s", "8": "b", "6": "b", "9": "g", "3": "e", "c": "e", "¢": "e", "€": "e", "$": "s", "d": "ei", "h": "ii", "u": "ii", "m": "rn", "w": "vv", "ﬁ": "fi", "ﬂ": "fi", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffi"})
_SIGNS = {k: [(m, math.log(q)) for m, q in v] for k, v in CONFUSIONS.items() if not k.isalpha() or not k.isascii()}
_ONE = {k: [(m, math.log(q)) for m, q in v] for k, v in CONFUSIONS.items() if len(k) == 1 and k not in _SIGNS}
_TWO = {k: [(m, math.log(q)) for m, q in v] for k, v in CONFUSIONS.items() if len(k) == 2}
_PAIRS = {k[0] for k in _TWO}
_ODD = "†|$€¢ﬁﬂﬀﬃﬄ"
_LETTERS = r"[^\W\d_]"
_WORD = re.compile(rf"{_LETTERS}+(?:-{_LETTERS}+)*").findall
_TOKEN = re.compile(rf"[\w{re.escape(_ODD)}]*[^\W_{re.escape(_ODD)}][\w{re.escape(_ODD)}]*|[{re.escape(_ODD)}]+{_LETTERS}[\w{re.escape(_ODD)}]*")
_CUT = re.compile(rf"(?<!{_LETTERS})({_LETTERS}+(?:-{_LETTERS}+)*)([-¬\xad])[^\S\n]*\n\s*({_LETTERS}[\w{re.escape(_ODD)}]*(?:-{_LETTERS}+)*)")
_SPACED = re.compile(rf"(?<![\w])(?:{_LETTERS} ){{3,}}{_LETTERS}(?!\w)(?:-{_LETTERS}+)*")
_PAGE = re.compile(
    r"(?:[-–—~\[(]\s*)?(?:(?:page|pg\.?|p\.|seite)\s*)?\d{1,4}(?:\s*(?:/|of|von)\s*\d{1,4})?(?:\s*[-–—~\])])?|\d{1,4}\s*\|\s*p\s*a\s*g\s*e|(?=[ivxlc])(?:x{0,4}c?l?x{0,4}(?:ix|iv|v?i{0,3}))|page\s+[ivxlc]+", re.I
)
_LONG_WORD = re.compile(rf"{_LETTERS}{{4,}}").findall
_MAYBE_CUT = re.compile(r"[-¬\xad][^\S\n]*\n").search
_SIGNS_AT = re.compile(rf"[\d{re.escape(_ODD)}]+").finditer
_MAYBE_SPACED = re.compile(rf" {_LETTERS} {_LETTERS} {_LETTERS}").search
_STOP = re.compile(r"[.!?:;…][\"'”’»)\]]*\Z").search
_BULLET = re.compile(r"(?:[-–—•*·▪‣]|[(]?(?:\d{1,3}(?:\.\d{1,3})*|[A-Za-z]|[ivxIVX]{1,5})[.)]|\d{1,3}(?:\.\d{1,3})+)\s").match


def _hash(s: str) -> int:
    """The hash of a string as xxhash64 of Spark makes it."""
    h = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), seed=42)
    return h - (1 << 64) if h >= 1 << 63 else h


def shape(line: str) -> str:
    """A line as it recurs: without page numbers at its ends, digits alike, in lower case."""
    s = re.sub(r"^\d{1,4}\s{2,}|\s{2,}\d{1,4}$", "", line.strip())
    return re.sub(r"\s+", " ", re.sub(r"\d+", "9", s)).lower()


def title_like(line: str) -> bool:
    """Whether a line reads like a running title: short, without an end mark, most long words capitalised."""
    if len(line) > LONGEST or line[-1:] in ".,!?:;…" or _STOP(line):
        return False
    words = _LONG_WORD(line)
    return bool(words) and 2 * sum(w[0].isupper() for w in words) >= len(words)


def is_page_number(line: str) -> bool:
    s = line.strip()
    return 0 < len(s) <= 40 and _PAGE.fullmatch(s) is not None


def _lines(text: str) -> list[str]:
    return text.split("\n")


def interrupts(lines: list[str], i: int) -> bool:
    """Whether a line stands inside a sentence that goes on after it."""
    j = i - 1
    while j >= 0 and (not lines[j].strip() or is_page_number(lines[j])):
        j -= 1
    k = i + 1
    while k < len(lines) and (not lines[k].strip() or is_page_number(lines[k])):
        k += 1
    if j < 0 or k >= len(lines):
        return False
    before, after = lines[j].strip(), lines[k].strip()
    return not _STOP(before) and len(before) > 20 and (after[0].islower() or before[-1] in "-¬\xad")


def _cuts(lines: list[str], dropped) -> Iterator[tuple[re.Match, str]]:
    """Words cut at a line's end, with each line they may go on in, and both lines closed.

    Lines for which `dropped` holds may be page furniture: the word may go on in them or after them.
    """
    for i, line in enumerate(lines):
        if not line.strip() or line.rstrip()[-1] not in "-¬\xad":
            continue
        for j in range(i + 1, len(lines)):
            if lines[j].strip():
                pair = f"{line}\n{lines[j]}"
                m = _CUT.search(pair)
                if m:
                    yield m, _CUT.sub(r"\1\3", pair)
                if not dropped(j):
                    break


class _Parts(dict):
    """Numbers of the parts of texts between white space; -1 for mere punctuation, which doesn't part words."""

    def __init__(self) -> None:
        super().__init__()
        self.names: list[str] = []

    def __missing__(self, chunk: str) -> int:
        if any(map(str.isalnum, chunk)):
            self.names.append(chunk)
            got = self[chunk] = len(self.names) - 1
        else:
            got = self[chunk] = -1
        return got


class _Counted:
    """How often parts of texts (words with their punctuation) occur, and which follow each other."""

    def __init__(self) -> None:
        self.parts = _Parts()
        self.waiting: list[np.ndarray] = []
        self.size = 0
        self.pairs = np.empty(0, np.int64)
        self.n = np.empty(0, np.int64)
        self.counts = np.zeros(0, np.int64)

    def add(self, text: str) -> None:
        found = text.split()
        at = np.fromiter(map(self.parts.__getitem__, found), np.int64, len(found))
        self.waiting.append(at[at >= 0])
        self.size += len(found)
        if self.size > 1_000_000:
            self.sum()

    def sum(self) -> None:
        """Sum up what was added: pairs of one text only."""
        if not self.waiting:
            return
        at = np.concatenate(self.waiting)
        counts = np.bincount(at, minlength=len(self.parts.names))
        counts[: len(self.counts)] += self.counts
        self.counts = counts
        ends = np.cumsum([len(x) for x in self.waiting])
        inside = np.ones(len(at), bool)
        inside[ends[ends > 0] - 1] = False
        inside = inside[:-1]
        pairs, n = np.unique((at[:-1] << 32 | at[1:])[inside], return_counts=True)
        both, n_both = np.concatenate([self.pairs, pairs]), np.concatenate([self.n, n])
        self.pairs, where = np.unique(both, return_inverse=True)
        self.n = np.bincount(where, n_both, len(self.pairs)).astype(np.int64)
        self.waiting, self.size = [], 0


def _observe(text: str, counted: _Counted, odd: set[str], seen: dict[tuple[str, int], int]) -> None:
    """Count the parts of a text and the lines that may be running ones."""
    counted.add(text)
    if _MAYBE_SPACED(text):
        odd.update(x for m in _SPACED.finditer(text.lower()) for x in _TOKEN.findall(m[0].replace(" ", "")) if _correctable(x))
    if "\n" in text:
        lines = _lines(text)
        if _MAYBE_CUT(text):
            for _, closed in _cuts(lines, lambda j: is_page_number(lines[j]) or title_like(lines[j].strip())):
                odd.update(x for x in _TOKEN.findall(closed.lower()) if _correctable(x))
        for i, line in enumerate(lines):
            s = line.strip()
            if s and title_like(s) and not is_page_number(s):
                j = i - 1
                while j >= 0 and not lines[j].strip():
                    j -= 1
                at = (shape(s), _hash(lines[j].strip()) if j >= 0 else 0)
                seen[at] = max(seen.get(at, 0), int(interrupts(lines, i) or line.startswith("\f") and 0 < i))


class _Words(dict):
    """The words and other correctable tokens of a part of a text, in lower case."""

    def __missing__(self, chunk: str) -> tuple[list[str], list[str]]:
        low = chunk.lower()
        words = _WORD(low)
        got = self[chunk] = words, [] if words == [low] else [x for x in _TOKEN.findall(low) if x not in words and _correctable(x)]
        return got


def _is_odd(w: str) -> bool:
    return any(c in _ODD or c.isdigit() for c in w)


def _correctable(w: str) -> bool:
    """Whether a token (in lower case) can be a misreading: long enough, and mostly letters."""
    if not 4 <= len(w) <= 40:
        return False
    letters = sum(map(str.isalpha, w))
    return letters >= 2 and not (letters < len(w) / 2 and _is_odd(w))


@dataclass
class Corpus:
    """What all texts of a table tell: counts of words(word, n) and pairs(h, n) by hash, the readings that the corpus
    supports, choices(word, found), running lines, running(shape), the number of all words, and the filter."""

    words: DataFrame
    pairs: DataFrame
    choices: DataFrame
    running: DataFrame
    total: int
    bits: np.ndarray


_FOUND = "array<struct<word:string,p:double,n:long>>"


def corpus_counts(texts: DataFrame, text: str = "text") -> Corpus:
    """Word and pair counts, readings and running lines of all texts of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = _Counted()
        odd: set[str] = set()
        seen: dict[tuple[str, int], int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            counted.sum()
            parts: Counter = Counter()
            pairs: Counter = Counter()
            total, of = 0, _Words()
            first, last = [], []
            for chunk, c in zip(counted.parts.names, counted.counts.tolist()):
                words, others = of[chunk]
                odd.update(others)
                total += c * len(words)
                first.append(words[0] if words else None)
                last.append(words[-1] if words else None)
                for w in words:
                    parts[w] += c
                    if "-" in w:
                        for x in w.split("-"):
                            parts[x] += c
                for p in zip(words, words[1:]):
                    pairs[p] += c
            for a, b, c in zip((counted.pairs >> 32).tolist(), (counted.pairs & 0xFFFFFFFF).tolist(), counted.n.tolist()):
                v, w = last[a], first[b]
                if v and w:
                    pairs[v, w] += c
            kinds = (
                (0, list(parts), None, list(parts.values())),
                (1, None, [_hash(f"{v} {w}") for v, w in pairs], list(pairs.values())),
                (2, [s for s, _ in seen], [h for _, h in seen], list(seen.values())),
                (3, None, None, [total]),
                (4, list(odd), None, [0] * len(odd)),
            )
            for kind, s, h, n in kinds:
                if n:
                    none = [None] * len(n)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(n), pa.int32()), pa.array(s or none, pa.string()), pa.array(h or none, pa.int64()), pa.array(n, pa.int64())], ["kind", "s", "h", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    _observe(t, counted, odd, seen)
            if len(counted.pairs) > 2_000_000 or len(counted.parts) > 1_000_000:
                yield from flush()
                counted = _Counted()
                odd.clear()
                seen.clear()
        yield from flush()

    made = texts.select(F.col(text).alias("t")).where(F.length("t") > 0).mapInArrow(run, "kind int, s string, h long, n long")
    counted = cut(made.groupBy("kind", "s", "h").agg(F.sum("n").alias("n")))
    total = counted.where("kind = 3").agg(F.sum("n")).first()[0] or 0
    words = counted.where("kind = 0").select(F.col("s").alias("word"), "n")
    # A line counts once for each surrounding, so that copies of a text don't make their lines recur.
    recur = counted.where("kind = 2").groupBy(F.col("s").alias("shape")).agg(F.count("*").alias("m"), F.count_if(F.col("n") > 0).alias("n"))
    running = cut(recur.where((F.col("m") >= SURROUNDINGS) & (F.col("n") * 2 >= F.col("m"))).select("shape"))
    choices = cut(_choices(words.unionByName(counted.where("kind = 4").select(F.col("s").alias("word"), F.lit(0).cast("long").alias("n"))), total))
    asked = choices.select(F.concat(F.lit("c:"), "word").alias("q")).unionByName(running.select(F.concat(F.lit("s:"), "shape").alias("q")))
    at = asked.select(F.xxhash64("q").bitwiseAND(F.lit(BITS - 1)).cast("int").alias("b")).distinct().toArrow().column("b").to_numpy()  # at most BITS rows
    flags = np.zeros(BITS, np.uint8)
    flags[at] = 1
    return Corpus(words, counted.where("kind = 1").select("h", "n"), choices, running, total, np.packbits(flags, bitorder="little"))


def _choices(tokens: DataFrame, total: int) -> DataFrame:
    """word, found: the readings (word, p, n) that the corpus supports for each of tokens(word, n) that may be misread.

    Tokens of one key are brought together; there are as many as different ways to read one word.
    """
    #: Words more frequent than this are no misreadings.
    most = max(50 * KNOWN, total * 3e-5)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws = b.column(0).to_pylist()
            at = [i for i, w in enumerate(ws) if _correctable(w)]
            yield pa.RecordBatch.from_arrays([pa.array([ws[i].translate(_KEY) for i in at], pa.string()), b.column(0).take(pa.array(at, pa.int64())), b.column(1).take(pa.array(at, pa.int64()))], ["key", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(rows: list[tuple[str, list[tuple[str, float, int]]]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([[{"word": r, "p": p, "n": n} for r, p, n in f] for _, f in rows], pa.list_(pa.struct([("word", pa.string()), ("p", pa.float64()), ("n", pa.int64())])))], ["word", "found"])

        now, group, out = None, [], []
        for b in batches:
            for key, w, n in zip(*(c.to_pylist() for c in b.columns)):
                if key != now:
                    out += _readings_of(group, most)
                    now, group = key, []
                    if len(out) > 5000:
                        yield result(out)
                        out = []
                group.append((w, n))
        out += _readings_of(group, most)
        if out:
            yield result(out)

    keyed = tokens.select("word", "n").mapInArrow(keys, "key string, word string, n long")
    return keyed.repartition("key").sortWithinPartitions("key", "word").mapInArrow(run, f"word string, found {_FOUND}")


def _readings_of(group: list[tuple[str, int]], most: float) -> list[tuple[str, list[tuple[str, float, int]]]]:
    """For the words (with counts) of one key: those that may be misread, with the readings that the corpus supports."""
    known = {w: n for w, n in group if n >= KNOWN and w.isalpha()}
    if not known:
        return []
    counted: dict[str, int] = {}
    for w, n in group:  # what was seen in a closed form only comes with 0
        counted[w] = max(n, counted.get(w, 0))
    group = [*counted.items()]
    whole = sum(n for _, n in group)
    out = []
    for w, n in group:
        odd = _is_odd(w)
        rest = whole - n  # of all words that could be read so
        if n >= most or rest < KNOWN or rest < ODDS * n:
            continue
        # Two confusions in a word are tried if one doesn't explain it and the word isn't known itself.
        for depth in (0, 1, 2) if odd else (1, 2)[: 2 if n < KNOWN else 1]:
            found = [(r, p, known[r]) for r, p in Repairer._readings(w, depth).items() if r != w and len(r) >= 4 and known.get(r, 0) >= ODDS * n and r in known]
            if found:
                out.append((w, sorted(found, key=lambda x: -x[1] - math.log(x[2]))[:6]))
                break
    return out


class Repairer:
    """Repairs one text at a time with what was looked up for it."""

    def __init__(self, total: int, facts: list[dict] | None = None, numbers: list[dict] | None = None) -> None:
        self.total = max(1, total)
        facts = facts or []
        self.known: dict[str, int] = {f["q"][2:]: f["n"] for f in facts if f["q"][0] == "w"}
        self.options = {f["q"][2:]: tuple((x["word"], x["p"]) for x in f["found"]) for f in facts if f["q"][0] == "c"}
        self.lines = {f["q"][2:] for f in facts if f["q"][0] == "s"}
        for f in facts:
            if f["q"][0] == "c":
                self.known |= {x["word"]: x["n"] for x in f["found"]}
        self.numbers = {f["h"]: f["n"] for f in numbers or []}

    def count(self, w: str) -> int:
        n = self.known.get(w)
        return n if n is not None else self.numbers.get(_hash(w), 0)

    def pair(self, v: str, w: str) -> int:
        return self.numbers.get(_hash(f"{v} {w}"), 0)

    @staticmethod
    def _confused(s: str) -> Iterator[tuple[str, float]]:
        """Readings of s that differ by one confusion of letters."""
        for i, c in enumerate(s):
            for meant, q in _ONE.get(c, ()):
                yield s[:i] + meant + s[i + 1 :], q
            if c in _PAIRS:
                for meant, q in _TWO.get(s[i : i + 2], ()):
                    yield s[:i] + meant + s[i + 2 :], q

    @staticmethod
    def _readings(w: str, depth: int) -> dict[str, float]:
        """What may have been meant by w, with the logarithm of the channel's probability.

        Signs that are no letters are replaced in every case; beyond those at most `depth` confusions are undone.
        """
        layer = {"": 0.0}
        for c in w:
            options = _SIGNS.get(c)
            layer = {k + c: v for k, v in layer.items()} if options is None else {k + m: v + q for k, v in layer.items() for m, q in options}
            if len(layer) > 64:
                return {}
        best = dict(layer)
        for _ in range(depth):
            nxt: dict[str, float] = {}
            for t, v in layer.items():
                for r, q in Repairer._confused(t):
                    if r not in best or best[r] < v + q:
                        best[r] = nxt[r] = v + q
            layer = nxt
        return best

    def candidates(self, token: str) -> tuple[tuple[str, float], ...]:
        """The readings of a token that the corpus supports; empty if it stands as it is."""
        return self.options.get(token.lower(), ())

    def _rows(self, tokens: list[str]) -> list[list[tuple[str, float]]]:
        """The options of each token of a line: itself and its readings."""
        out = []
        for t in tokens:
            w, c = t.lower(), self.candidates(t)
            out.append([(w, -12.0 if c and any(x in _ODD for x in w) else 0.0), *c])
        return out

    def _viterbi(self, rows: list[list[tuple[str, float]]]) -> list[str]:
        """The likeliest words of a line. What stands between two words without a choice is the same for all."""

        def unigram(w: str) -> float:
            return math.log((self.count(w) + 0.1) / self.total)

        def bigram(v: str, w: str) -> float:
            pw = (self.count(w) + 0.1) / self.total
            return math.log((self.pair(v, w) + 20 * pw) / (self.count(v) + 20))

        # Figures and the like are no words of the corpus and say nothing about their neighbours.
        word = [len(options) > 1 or options[0][0].isalpha() for options in rows]
        table: list[dict[str, tuple[float, str | None]]] = []
        for i, options in enumerate(rows):
            row: dict[str, tuple[float, str | None]] = {}
            for r, p in options:
                if not table:
                    row[r] = (p + (unigram(r) if len(options) > 1 else 0.0), None)
                elif not word[i] or not word[i - 1]:
                    v, (s, _) = max(table[-1].items(), key=lambda x: x[1][0])
                    row[r] = (s + p + (unigram(r) if len(options) > 1 else 0.0), v)
                elif len(options) == len(rows[i - 1]) == 1:
                    v, (s, _) = next(iter(table[-1].items()))
                    row[r] = (s + p, v)
                else:
                    row[r] = max(((s + bigram(v, r) + p, v) for v, (s, _) in table[-1].items()), key=lambda x: x[0])
            table.append(row)
        w = max(table[-1], key=lambda r: table[-1][r][0])
        out = []
        for row in reversed(table):
            out.append(w)
            w = row[w][1]
        return out[::-1]

    def furniture(self, lines: list[str]) -> set[int]:
        """Running headers and footers and page numbers among the lines."""
        filled = [i for i, x in enumerate(lines) if x.strip()]
        if len(filled) < 2:
            return set()
        out = set()
        for i in filled:
            line, s = lines[i], lines[i].strip()
            page = line.startswith("\f")
            if is_page_number(s):
                bare_year = re.fullmatch(r"(?:1[89]|20)\d\d", s) is not None
                if not bare_year or page:
                    out.add(i)
            elif title_like(s):
                numbered = re.match(r"\d{1,4}\s{2,}\S|.*\S\s{2,}\d{1,4}$", s) is not None
                if page or shape(s) in self.lines or (numbered or s.isupper()) and interrupts(lines, i):
                    out.add(i)
        return out

    def joined(self, left: str, mark: str, right: str) -> str | None:
        """How a word cut at a line end goes on, or None if the hyphen is its own."""
        a, b = left.lower(), right.lower()
        head, tail = a.rsplit("-", 1)[-1], b.split("-", 1)[0]
        whole = self.count(head + tail)
        if mark == "-":
            own = self.count(f"{a}-{b}")
            if own >= KNOWN and own >= whole or own > 4 * whole:
                return None
            if whole < KNOWN and self.count(head) >= 5 * KNOWN and self.count(tail) >= 5 * KNOWN and not self.candidates(head + tail):
                return None
        return left + right

    def close(self, text: str) -> tuple[str, int]:
        """The text without page furniture, cut and spaced words closed, and the number of traces found so far."""
        traces = 0
        lines = _lines(text)
        body = text
        if len(lines) > 1:
            drop = self.furniture(lines)
            if drop:
                traces += len(drop)
                kept: list[str] = []
                for i, line in enumerate(lines):
                    if i in drop:
                        while kept and not kept[-1].strip():
                            kept.pop()
                        kept.append("")  # a sign for the place, so that a sentence can go on over it
                    elif line.strip() or not kept or kept[-1] != "":
                        kept.append(line)
                body = re.sub("\n?(?:\n?)+", lambda m: "\n", "\n".join(kept)).strip("\n")

            def close(m: re.Match) -> str:
                nonlocal traces
                w = self.joined(m[1], m[2], m[3])
                if w is None:
                    return f"{m[1]}-{m[3]}"
                traces += 1
                return w

            closed = _CUT.sub(close, body) if _MAYBE_CUT(body) else body
        else:
            closed = body

        def unspace(m: re.Match) -> str:
            nonlocal traces
            w = m[0].replace(" ", "")
            if self.count(w.lower()) >= KNOWN or self.candidates(w) or len(w) >= 6:
                traces += 1
                return w
            return m[0]

        if _MAYBE_SPACED(closed):
            closed = _SPACED.sub(unspace, closed)
        return closed, traces

    def suspects(self, closed: str) -> Iterator[tuple[int, str, list[re.Match], list[list[tuple[str, float]]]]]:
        """The lines with tokens that may be misread: number, line, tokens, options."""
        low = closed.lower()
        found = [t for t in self.options if t in low]
        for k, line in enumerate(closed.split("\n")) if found else ():
            low = line.lower()
            if any(t in low for t in found):
                spans = [*_TOKEN.finditer(line)]
                rows = self._rows([m[0] for m in spans])
                if any(len(options) > 1 for options in rows):
                    yield k, line, spans, rows

    def needs(self, rows: list[list[tuple[str, float]]]) -> set[int]:
        """Hashes of the words and pairs whose counts decide between the options of a line."""
        out: set[int] = set()
        for a, b in zip([[], *rows], [*rows, []]):
            if len(a) > 1 or len(b) > 1:
                out.update(_hash(w) for w, _ in (*a, *b))
                out.update(_hash(f"{v} {w}") for v, _ in a for w, _ in b)
        return out

    def finish(self, closed: str, traces: int, with_text: bool = True) -> tuple[str | None, int]:
        """The closed text in continuous paragraphs (None if nothing was found in it), and the number of traces."""
        out = closed.split("\n")
        for k, line, spans, rows in self.suspects(closed):
            parts, at = [], 0
            for m, options, w in zip(spans, rows, self._viterbi(rows)):
                if len(options) > 1 and w != m[0].lower():
                    traces += 1
                    parts += [line[at : m.start()], w.upper() if m[0].isupper() and len(m[0]) > 1 else w.capitalize() if m[0][0].isupper() else w]
                    at = m.end()
            out[k] = "".join(parts) + line[at:]
        return (self._reflow(out) if with_text and traces else None), traces

    @staticmethod
    def _reflow(lines: list[str]) -> str:
        """Lines joined to paragraphs; headings, list items and blank lines keep their places."""
        width = max((len(x) for x in lines), default=0)
        out: list[str] = []
        for line in lines:
            s = line.strip()
            if not s:
                out.append("")
                continue
            previous = out[-1] if out else ""
            own = not previous or _BULLET(s) or (_STOP(previous) and len(previous) < width * 0.6) or (title_like(previous) and not s[0].islower() and len(previous) < width * 0.6)
            if own:
                out.append(s)
            else:
                out[-1] = f"{previous} {s}"
        return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n")


class Asker(dict):
    """What has to be looked up for a text: counts of words (w:), readings (c:), running lines (s:).

    As a dict it has the questions of the parts of texts between white space, remembered up to a bound.
    """

    def __init__(self, bits: np.ndarray) -> None:
        super().__init__()
        self.bits, self.mask = memoryview(bits), 8 * len(bits) - 1

    def maybe(self, q: str) -> bool:
        at = _hash(q) & self.mask
        return bool(self.bits[at >> 3] >> (at & 7) & 1)

    def __missing__(self, chunk: str) -> tuple[str, ...]:
        if len(self) > 500_000:
            self.clear()
        got = self[chunk] = tuple(q for q in ("c:" + x for x in _TOKEN.findall(chunk.lower())) if self.maybe(q))
        return got

    def suspects(self, text: str) -> Iterator[str]:
        """Questions for the tokens of a text, which white space parts."""
        return chain.from_iterable(filter(None, map(self.__getitem__, set(text.split()))))

    def __call__(self, text: str) -> list[str] | None:
        """The questions, or None if the text can have no trace of scanning."""
        out: set[str] = set()
        lines, any_ = _lines(text), False
        filled = [i for i, x in enumerate(lines) if x.strip()] if len(lines) > 1 else []
        maybe = set()
        for i in filled if len(filled) > 1 else ():
            s = lines[i].strip()
            if is_page_number(s):
                maybe.add(i)
            elif title_like(s):
                q = "s:" + shape(s)
                if self.maybe(q):
                    out.add(q)
                    maybe.add(i)
                elif lines[i].startswith("\f") or interrupts(lines, i):
                    maybe.add(i)
        any_ = bool(maybe)
        for m, closed in _cuts(lines, maybe.__contains__) if _MAYBE_CUT(text) else ():
            a, b = m[1].lower(), m[3].lower()
            head, tail = a.rsplit("-", 1)[-1], b.split("-", 1)[0]
            out.update(f"w:{w}" for w in (head + tail, f"{a}-{b}", head, tail))
            out.add("c:" + head + tail)
            out.update(self.suspects(closed))
            any_ = True
        for m in _SPACED.finditer(text) if _MAYBE_SPACED(text) else ():
            w = m[0].replace(" ", "").lower()
            out.update(("w:" + w, "c:" + w))
            out.update("c:" + x for x in _TOKEN.findall(w))
            any_ = True
        out.update(self.suspects(text))
        return list(out) if out or any_ else None


_ASK, _ROW, _FACTS, _NUMBERS, _CLOSED, _FIRST = (f"_lexgraph_{x}" for x in ("ask", "row", "facts", "numbers", "closed", "first"))


def repair_scanned(df: DataFrame, corpus: Corpus, text: str = "text", out: str = "repaired", traces: str = "traces", with_text: bool = True) -> DataFrame:
    """Add the repaired text and the number of traces of scanning found in it.

    A text without traces stays as it is, null and empty ones too (0 traces). Columns named like the new ones are
    replaced, others pass through; one output row per input row. Without with_text only the number is added.
    """
    bits = df.sparkSession.sparkContext.broadcast(corpus.bits)
    new = [out, traces] if with_text else [traces]
    keep = [c for c in df.columns if c.lower() not in {x.lower() for x in new} or c == text]
    last = [c for c in keep if c.lower() not in {x.lower() for x in new}]
    done = {out: F.col(text), traces: F.lit(0)}

    def ask():
        asker = Asker(bits.value)
        return lambda texts: [pa.array([asker(t) if t else None for t in texts.to_pylist()], pa.list_(pa.string()))]

    asked = add_columns(df.select(*keep), [text], [T.StructField(_ASK, T.ArrayType(T.StringType()))], ask)
    clean = asked.where(F.col(_ASK).isNull()).select(*last, *(done[c].alias(c) for c in new))
    some = cut(asked.where(F.col(_ASK).isNotNull()).withColumn(_ROW, F.monotonically_increasing_id()))

    # First what words, readings and lines there are, then the counts that decide between readings.
    none = F.lit(None).cast(_FOUND)
    facts = corpus.words.select(F.concat(F.lit("w:"), "word").alias("q"), "n", none.alias("found"))
    facts = facts.unionByName(corpus.choices.select(F.concat(F.lit("c:"), "word").alias("q"), F.lit(0).cast("long").alias("n"), "found"))
    facts = facts.unionByName(corpus.running.select(F.concat(F.lit("s:"), "shape").alias("q"), F.lit(1).cast("long").alias("n"), none.alias("found")))
    answers = some.select(_ROW, F.explode(_ASK).alias("q")).join(facts, "q").groupBy(_ROW).agg(F.collect_list(F.struct("q", "n", "found")).alias(_FACTS))
    total = corpus.total

    def need():
        def f(texts: pa.Array, facts: pa.Array) -> list[pa.Array]:
            closed, first, asks, kept = [], [], [], []
            for t, k in zip(texts.to_pylist(), facts.to_pylist()):
                r = Repairer(total, k)
                c, n = r.close(t)
                lines = [(spans, rows) for _, _, spans, rows in r.suspects(c)]
                closed.append(c)
                first.append(n)
                asks.append(list({h for _, rows in lines for h in r.needs(rows)}))
                tokens = {m[0].lower() for spans, _ in lines for m in spans}
                kept.append([x for x in k or () if x["q"][0] == "c" and x["q"][2:] in tokens])
            return [pa.array(closed, pa.string()), pa.array(first, pa.int32()), pa.array(asks, pa.list_(pa.int64())), pa.array(kept, facts.type)]

        return f

    fields = [T.StructField(_CLOSED, T.StringType()), T.StructField(_FIRST, T.IntegerType()), T.StructField(_ASK, T.ArrayType(T.LongType())), T.StructField(_FACTS, answers.schema[_FACTS].dataType)]
    joined = some.drop(_ASK).join(answers, _ROW, "left").withColumn(f"{_FACTS}_", F.col(_FACTS))
    some = cut(add_columns(joined, [text, f"{_FACTS}_"], fields, need).drop(f"{_FACTS}_", *([] if with_text else [c for c in df.columns if c not in last])))
    counts = corpus.pairs.unionByName(corpus.words.select(F.xxhash64("word").alias("h"), "n"))
    numbers = some.select(_ROW, F.explode(_ASK).alias("h")).join(counts, "h").groupBy(_ROW).agg(F.collect_list(F.struct("h", "n")).alias(_NUMBERS))

    def make():
        def f(texts: pa.Array, closed: pa.Array, first: pa.Array, facts: pa.Array, numbers: pa.Array) -> list[pa.Array]:
            got = []
            for c, n, k, x in zip(*(v.to_pylist() for v in (closed, first, facts, numbers))):
                got.append(Repairer(total, k, x).finish(c, n, with_text) if k or n and with_text else (None, n))
            n = pa.array([x for _, x in got], pa.int32())
            return [pa.array([d if d is not None else t for t, (d, _) in zip(texts.to_pylist(), got)], pa.string()), n] if with_text else [n]

        return f

    fields = [T.StructField(f"{_ROW}_{c}", T.StringType() if c == out else T.IntegerType()) for c in new]
    repaired = add_columns(some.join(numbers, _ROW, "left"), [text if with_text else _CLOSED, _CLOSED, _FIRST, _FACTS, _NUMBERS], fields, make)
    return clean.unionByName(repaired.select(*last, *(F.col(f"{_ROW}_{c}").alias(c) for c in new)))
