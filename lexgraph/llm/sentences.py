"""Sentence units across languages and scripts.

Every character of a text is tagged as inside a unit or as its boundary by a linear-chain model. Only characters
after which a unit can end (end marks with their closing signs, line ends, spaces of scripts without end marks)
have an uncertain tag, so Viterbi decoding runs over those. Emission scores are a log-linear model whose weights
start from stated priors and are fitted on silver labels of a bounded sample: the ends of paragraphs, taken without
the line break, are boundaries; a mark before a lower-case word is none. Counts over all documents tell how often a
word with a full stop ends a paragraph (abbreviations don't) and how often a capitalised word opens a sentence.
Scripts without end marks are learned from text stripped of its punctuation: what stands at the joints of paragraphs
against what stands inside, counted over all documents, weighed by a model fitted on the sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrowmap import explode_rows
from ..runtime import cut

#: Documents the model is fitted on, chosen by a hash.
SAMPLE = 4000
#: Least count of a word, and least share of all words counted, to be in the model: at most 1 / SHARE words are sent out.
LEAST, SHARE = 5, 2e-6

_CLOSE = "\"'”’»«“‘」』)\\]）】〉》›"
_SHUT = "\"'”’»」』)\\]）】〉》›"
_OPEN = "\"'“‘„«»「『(\\[（【〈《‹¿¡‚"
_BLIND = "​‌‍‎‏⁠﻿\xad"
_RUNS = "฀-໿က-႟ក-៿"  # Thai, Lao, Myanmar, Khmer: no marks at the end
_ENDS = re.compile(rf"(?P<t>[.!?…‥]+)(?P<c>(?:[{_CLOSE}]|[^\S\n]»)*)(?P<s>[\s{_BLIND}]+|\Z|(?<=[a-zà-ÿ]{{3}}[.!?])(?=[A-ZÀ-Þ¿¡(“„«])|(?<=[\u0620-\u064a]{{3}}[.!])(?=[\u0620-\u064a]))|(?P<u>[。！？｡।॥؟۔።]+)(?P<v>(?:[{_SHUT}]|[^\S\n]»)*)(?P<w>[\s{_BLIND}]*)|(?P<n>[^\S\n]*\n\s*)")
_ENDS_RUNS = re.compile(_ENDS.pattern + rf"|(?<=[{_RUNS}\d{_CLOSE}])(?P<r>[^\S\n]+)(?=[{_RUNS}{_OPEN}\d])")
_HAS_RUNS = re.compile(f"[{_RUNS}]").search
_BULLET = re.compile(r"(?:[-–—•*·▪‣◦]|[(（]?(?:\d{1,3}(?:\.\d{1,3})*|[A-Za-z]|[ivxIVX]{1,5})[.)）]|\d{1,3}(?:\.\d{1,3})+)\s").match
_STRONG = re.compile(r"[-–—•*·▪‣◦]\s|[(（](?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,5})[)）]\s|\d{1,3}(?:\.\d{1,3})+\s|(?:\d{1,3}|[A-Za-z])[)）]\s").match
_MARK = re.compile(r"[(（]?(?:\d{1,3}(?:\.\d{1,3})*|[A-Za-z]|[ivxIVX]{1,5})[.)）]?\Z").match
_LAST_WORD = re.compile(rf"[^\s{_OPEN}–—]+\Z").search
_FIRST = re.compile(rf"[\s{_OPEN}{_BLIND}]*").match
_NEXT_WORD = re.compile(r"[^\W\d_]+").match
_WORDS = re.compile(r"[^\W\d_]+").findall
_BREAKING = re.compile(r"[ \t]+")
_VISIBLE = re.compile(r"[^\W_]")

#: Prior weights of the features (fixed values): the sign says whether the feature speaks for a boundary.
PRIOR = {
    "t=.": 1.5, "t=!": 2.5, "t=…": -1.5, "t=full": 4.0, "t=none": -1.0, "t=run": 2.5,
    "next=low": -7.0, "next=up": 2.0, "next=dig": -1.0, "next=bullet": 2.0, "next=caseless": 1.0, "next=other": -0.5, "next=end": 12.0,
    "gap=space": 0.0, "gap=line": 0.0, "gap=blank": 6.0, "gap=joined": -0.5,
    "line=room": 3.5, "line=full": -5.0, "line=bullet": 2.0, "line=bullet!": 8.0, "line=lead": 2.0, "line=soft": -2.0,
    "run=dig": -8.0, "line=shared": -7.0, "quote=first": -9.0, "quote=later": 1.0, "quote=particle": -7.0, "dig=.": -2.0, "low=full": 3.0,
}

#: Prior weights of what stands before and after a place in scripts without end marks (fixed values).
RUN_PRIOR = (0.5, 1.0)


def _kind(text: str, at: int) -> str:
    """What the text at a place starts with: a bullet, capital, small letter, digit, caseless letter, other, end."""
    at = _FIRST(text, at).end()
    if at >= len(text):
        return "end"
    c = text[at]
    if c.isdigit():
        return "dig"
    if c.islower():
        return "up" if text[at + 1 : at + 2].isupper() or text[at + 1 : at + 2] == "-" and text[at + 2 : at + 3].isupper() else "low"  # a name such as iPhone may open a sentence
    if c.isupper() or c.istitle():
        return "up"
    return "caseless" if c.isalpha() else "other"


def _opened_first(text: str, close: str, end: int) -> bool:
    """Whether the quotation closed at `end` opened where a sentence starts."""
    opener = {"”": "“", "’": "‘", "»": "«", "」": "「", "』": "『", "“": "„", "‘": "‚", "«": "»"}.get(close, close)
    i = text.rfind(opener, 0, end - 1)
    if i < 0:
        return False
    before = text[max(0, i - 3) : i].rstrip(" \xa0\t")
    return not before or before[-1] in "\n.!?。！？।؟" + "”»」』)）"


@dataclass
class Candidate:
    start: int  # where the gap begins: the end of the unit if it is a boundary
    end: int
    features: tuple[str, ...]
    word: str = ""  # before a single full stop
    after: str = ""  # the capitalised word after it
    run: str = ""  # two characters on either side, in scripts without end marks
    mark: bool = False  # looks like the number of a paragraph or item
    gap: str = ""
    line: bool = False  # a line end without a mark


def _room(text: str) -> dict[int, str]:
    """For each line end, whether the next word would have fitted on the line: a deliberate break, or wrapping."""
    lines = text.split("\n")
    out, at, k = {}, 0, 0
    length = [len(x.rstrip()) for x in lines]
    while k < len(lines):
        j = k
        while j < len(lines) and length[j]:
            j += 1
        for i in range(k, min(j, len(lines) - 1)):
            nxt = _BREAKING.split(lines[i + 1].strip(), 1)
            need = 1 if nxt[0][:1] >= "฀" else len(nxt[0])
            width = max(length[max(k, i - 4) : min(j, i + 5)])  # of the lines around: paragraphs may be wrapped differently
            out[at + len(lines[i])] = "room" if length[i] + 1 + need <= width else "full"
            at += len(lines[i]) + 1
        if j < len(lines):
            at += len(lines[j]) + 1
        k = j + 1
    return out


def candidates(text: str) -> list[Candidate]:
    out = []
    room = _room(text) if "\n" in text.strip() else {}
    for m in (_ENDS_RUNS if _HAS_RUNS(text) else _ENDS).finditer(text):
        end, kind = m.end(), m.lastgroup
        if kind == "s":
            mark, close, start = m["t"], m["c"], m.start("s")
        elif kind == "w":
            mark, close, start = m["u"], m["v"], m.start("w")
        else:
            mark, close, start = "", "", m.start()
        gap = text[start:end]
        lines = gap.count("\n")
        nxt = "end" if end >= len(text) else _kind(text, end)
        bullet = lines > 0 and _BULLET(text, end) is not None
        f = []
        word = run = after = ""
        is_mark = False
        if kind == "s":
            t = "…" if mark[-1] in "…‥" or mark.endswith("..") else "!" if "!" in mark or "?" in mark else "."
            f.append("t=" + t)
            if t == ".":
                w = _LAST_WORD(text, max(0, m.start() - 24), m.start())
                word = w[0].lower() if w else ""
                if word.replace(".", "").replace(",", "").isdigit():
                    word = "9"
                is_mark = w is not None and _MARK(w[0]) is not None and not text[max(0, text.rfind("\n", 0, m.start()) + 1) : w.start()].strip(_OPEN + " \t\xa0\r" + _BLIND)
                if nxt == "dig" and not lines:
                    f.append("dig=.")
                if nxt == "up" and lines < 2:
                    n = _NEXT_WORD(text, _FIRST(text, end).end())
                    after = n[0] if n else ""
            elif nxt == "low" and "\n" in gap and t == "!":
                f.append("low=full")
        elif kind == "w":
            f.append("t=full")
            if nxt == "low":
                f.append("low=full")
        elif kind == "r":
            f.append("t=run")
            run = text[max(0, start - 2) : start] + "|" + text[end : end + 2]
            if nxt == "dig":
                f.append("run=dig")
        else:
            f.append("t=none")
        f.append("next=" + ("bullet" if bullet and nxt != "end" else nxt))
        f.append("gap=" + ("blank" if lines > 1 else "line" if lines else "space" if gap else "joined"))
        if lines == 1 and kind == "n":
            last = text[start - 1 : start]
            if out and not out[-1].gap.count("\n") and "t=none" not in out[-1].features and out[-1].end > text.rfind("\n", 0, start) and not {"next=low", "next=dig", "next=other"} & {*out[-1].features}:
                f.append("line=shared")  # a unit already ended on this line, so what follows isn't a line of its own
            f.append("line=" + room.get(text.index("\n", start), "full"))
            if bullet:
                strong = _STRONG(text, end) is not None
                f.append("line=bullet!" if strong or last in (":", "：", ";", "；") else "line=bullet")
            elif last in (":", "：", ";", "；"):
                f.append("line=lead")
            elif last in (",", "，", "、", "،"):
                f.append("line=soft")
        quote = next((c for c in close if c in "\"'”’»«“‘」』"), "")
        if quote and nxt != "end":
            first = _opened_first(text, quote, start)
            if text[end : end + 1] in ("と", "と", "って") and not lines:
                f.append("quote=particle")
            elif nxt in ("caseless", "low") and not lines:
                f.append("quote=first" if first else "quote=later")
        out.append(Candidate(start, end, tuple(f), word, after, run, is_mark, gap, "gap=line" in f and "t=none" in f and "next=bullet" not in f))
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    stops: dict[str, float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)
    runs: tuple[dict[str, float], dict[str, float]] = field(default_factory=lambda: ({}, {}))
    run_weights: tuple[float, float] = RUN_PRIOR
    unseen: float = 0.0

    def word_score(self, w: str) -> float:
        s = self.stops.get(w)
        if s is not None:
            return s
        return -2.5 if len(w) == 1 and w.isalpha() or "." in w else self.unseen

    def run_score(self, run: str) -> float:
        a, b = run.split("|", 1)
        left, right = self.runs
        return self.run_weights[0] * left.get(a, 0.0) + self.run_weights[1] * right.get(b[:1], 0.0)

    def score(self, c: Candidate) -> float:
        s = sum(self.weights.get(x, 0.0) for x in c.features)
        if c.word:
            w = self.word_score(c.word)
            s += w
            if c.after and (w < -1.0 or c.word == "9"):
                s += self.starts.get(c.after, -1.0)
        if c.run:
            s += self.run_score(c.run)
        return s

    def decode(self, text: str) -> list[int]:
        """Ends of the units of a text."""
        found = candidates(text)
        known: dict = self.__dict__.setdefault("_known", {})
        # Viterbi over (inside, boundary); a mark right after a boundary belongs to the unit it opens.
        inside, border, back = 0.0, -1e9, []
        previous, before_line = 0, False
        for c in found:
            key = (c.features, c.word, c.after, c.run)
            s = known.get(key)
            if s is None:
                if len(known) > 200_000:
                    known.clear()
                s = known[key] = self.score(c)
            opens = c.mark and (not back or previous_end_is_line_start(text, previous, c))
            from_inside, from_border = inside, border
            if opens:
                i_b = (from_inside + s, from_border + s - 20.0) if back else (-1e9, s - 20.0)
            elif before_line and c.line:
                i_b = (from_inside + s - 4.0, from_border + s)  # a unit that ran over a line end seldom stops at the next without a mark
            else:
                i_b = (from_inside + s, from_border + s)
            before_line = c.line
            boundary, bp = (i_b[0], 0) if i_b[0] >= i_b[1] else (i_b[1], 1)
            stay, sp = (from_inside, 0) if from_inside >= from_border else (from_border, 1)
            inside, border = stay, boundary
            back.append((sp, bp))
            previous = c.end
        tags = []
        tag = 1 if border > inside else 0
        for sp, bp in reversed(back):
            tags.append(tag)
            tag = bp if tag else sp
        return _units(text, [c.start for c, t in zip(found, reversed(tags)) if t])


def previous_end_is_line_start(text: str, previous: int, c: Candidate) -> bool:
    """Whether nothing but the mark stands between the candidate before and this one."""
    return len(text[previous : c.start].strip()) <= 10


def _units(text: str, ends: list[int]) -> list[int]:
    """Boundaries moved back to the last visible character; parts without a letter or digit join the one before."""
    tail = re.compile(rf"[\s{_BLIND}]+\Z")
    out, low = [], 0
    for e in [*ends, len(text)]:
        part = text[low:e]
        m = tail.search(part)
        stop = low + (m.start() if m else len(part))
        if stop <= low or not part.strip():
            continue
        if _VISIBLE.search(text, low, stop):
            out.append(stop)
        elif out:
            out[-1] = stop
        else:
            continue
        low = e
    if not out:
        m = tail.search(text)
        stop = m.start() if m else len(text)
        if stop > 0 and text[:stop].strip():
            out.append(stop)
    elif low < len(text):
        m = tail.search(text)
        stop = m.start() if m else len(text)
        if stop > low and text[low:stop].strip():
            out[-1] = stop
    return out


def stripped_paragraphs(text: str) -> list[str]:
    """The paragraphs of a text without their punctuation and spaces."""
    found = [re.sub(r"[^\w฀-໿က-႟ក-៿]+", "", p) for p in re.split(r"\n\s*\n", text)]
    return [p for p in found if p]


@dataclass
class Counts:
    """Counts over documents: words before a full stop (all, at paragraph ends), capitalised words (all, opening a
    sentence), and in scripts without end marks two characters before and one after a place (at joints, inside)."""

    total: Counter = field(default_factory=Counter)
    final: Counter = field(default_factory=Counter)
    seen: Counter = field(default_factory=Counter)
    opens: Counter = field(default_factory=Counter)
    joins_l: Counter = field(default_factory=Counter)
    joins_r: Counter = field(default_factory=Counter)
    in_l: Counter = field(default_factory=Counter)
    in_r: Counter = field(default_factory=Counter)
    sums: dict[str, int] = field(default_factory=dict)

    def sum(self, name: str) -> int:
        """Of all that was counted, also of what is too rare to be kept."""
        return self.sums.get(name) or sum(getattr(self, name).values())

    def add_runs(self, text: str) -> None:
        paragraphs = stripped_paragraphs(text)
        for a, b in zip(paragraphs, paragraphs[1:]):
            self.joins_l[a[-2:]] += 1
            self.joins_r[b[:1]] += 1
        for p in paragraphs:
            if len(p) > 1:
                self.in_l[p[0]] += 1
                self.in_l.update(map("".join, zip(p[:-2], p[1:-1])))
                self.in_r.update(p[1:])

    def add_part(self, part: str, n: int) -> None:
        """A part of a text between white space: the word before its full stop, and its capitalised words."""
        w = _stopped(part)
        if w:
            self.total[w] += n
        for w in _WORDS(part):
            if w[0].isupper():
                self.seen[w] += n

    def add(self, text: str, parts: Counter) -> None:
        """A text; what its parts tell waits in `parts`, unless they are so long that they won't come again."""
        found = text.split()
        if max(map(len, found), default=0) <= 40:
            parts.update(found)
        else:
            for x in found:
                if len(x) <= 40:
                    parts[x] += 1
                else:
                    self.add_part(x, 1)
        for p in _PARAGRAPHS(text) if "\n" in text else (text,):
            p = p.strip()
            if not p:
                continue
            w = _stopped(p.rsplit(None, 1)[-1])
            if w:
                self.final[w] += 1
            n = _NEXT_WORD(p, _FIRST(p).end())
            if n and n[0][0].isupper():
                self.opens[n[0]] += 1
        for m in _ASKED(text):
            if m[1][0].isupper():
                self.opens[m[1]] += 1
        if not text.isascii() and _HAS_RUNS(text):
            self.add_runs(text)


_PARAGRAPHS = re.compile(r"\n\s*\n").split
_ASKED = re.compile(rf"[!?][{_CLOSE}]*\s[\s{_OPEN}{_BLIND}]*([^\W\d_]+)").finditer
_KINDS = ("total", "final", "seen", "opens", "joins_l", "joins_r", "in_l", "in_r")


_AFTER_STOP = _BLIND + "".join(c for c in _CLOSE if c != "\\")


def _stopped(part: str) -> str:
    """The word before the single full stop that ends a part of a text; empty if none does. Figures are one word."""
    s = part.rstrip(_AFTER_STOP)
    if s[-1:] != "." or s[-2:-1] in ".!?…‥":
        return ""
    m = _LAST_WORD(s, max(0, len(s) - 25), len(s) - 1)
    w = m[0].lower() if m else ""
    return "9" if w.replace(".", "").replace(",", "").isdigit() else w


def corpus_counts(df: DataFrame, text: str = "text") -> Counts:
    """Counts over all texts; words that are too rare to matter (LEAST, SHARE) are counted but not sent to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, parts = Counts(), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            for x, n in parts.items():
                c.add_part(x, n)
            for k in _KINDS:
                found = getattr(c, k)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["kind", "word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                c.add(t, parts)
            if len(parts) > 1_000_000:
                yield from flush()
                c, parts = Counts(), Counter()
        yield from flush()

    made = df.select(F.col(text).alias("t")).where(F.length("t") > 0).mapInArrow(run, "kind string, word string, n long")
    counted = cut(made.groupBy("kind", "word").agg(F.sum("n").alias("n")))
    sums = {r["kind"]: r["n"] for r in counted.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # eight rows
    out = Counts(sums=sums)
    least = {k: max(LEAST if k in ("total", "seen") else 1, SHARE * sums.get({"final": "total", "opens": "seen"}.get(k, k), 0)) for k in sums}
    # `final` and `opens` are wanted for the words kept of `total` and `seen`.
    pairs = counted.where("kind in ('total', 'final', 'seen', 'opens')").groupBy(F.when(F.col("kind").isin("total", "final"), "total").otherwise("seen").alias("of"), "word").agg(F.max(F.when(F.col("kind").isin("total", "seen"), F.col("n"))).alias("n"), F.max(F.when(F.col("kind").isin("final", "opens"), F.col("n"))).alias("m"))
    for r in pairs.where(((F.col("of") == "total") & (F.col("n") >= least.get("total", 1))) | ((F.col("of") == "seen") & (F.col("n") >= least.get("seen", 1)))).toLocalIterator():
        a, b = (out.total, out.final) if r["of"] == "total" else (out.seen, out.opens)
        a[r["word"]], b[r["word"]] = r["n"], r["m"] or 0
    for r in counted.where("kind in ('joins_l', 'joins_r', 'in_l', 'in_r')").toLocalIterator():
        getattr(out, r["kind"])[r["word"]] = r["n"]
    return out


def text_counts(texts: list[str]) -> Counts:
    """The same counts of a few texts."""
    c, parts = Counts(), Counter()
    for text in texts:
        c.add(text, parts)
    for x, n in parts.items():
        c.add_part(x, n)
    return c


def _logistic(x, y, prior, rounds: int, pull: float):
    """Weights of a logistic model with a constant, held at their priors."""
    import numpy as np

    w, base = np.array(prior, float), math.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-np.clip(x @ w + base, -30, 30))) - y
        base -= 4 * g.mean()
        w -= 4 * (x * g[:, None]).mean(0) + 0.5 * pull * (w - np.array(prior))
    return w


def fit(texts: list[str], counts: Counts | None = None, rounds: int = 60, pull: float = 0.02) -> Model:
    """Fit on whole texts, with counts over all documents or else of these texts.

    pull: how strongly the weights are held at their priors.
    """
    import numpy as np

    c = counts or text_counts(texts)
    examples: list[tuple[tuple[str, ...], str, float]] = []
    for text in texts:
        for m in candidates(text):
            blank = m.gap.count("\n") > 1 or m.end >= len(text)
            known = [x for x in m.features if x.startswith(("t=", "next=", "dig=", "low=", "quote="))]
            if "t=none" in known or "t=run" in known:
                continue
            if blank and m.end < len(text):
                examples.append(((*known, "gap=space"), m.word, 1.0))
            elif "next=low" in known and "\n" not in m.gap and "t=full" not in known:
                examples.append(((*known, "gap=space"), m.word, 0.0))
    model = Model()
    share = (c.sum("final") + 1) / (c.sum("total") + 2)
    model.stops = {w: math.log((c.final[w] + 2 * share) / ((n + 2) * share)) for w, n in c.total.items() if n >= LEAST}
    part = (c.sum("opens") + 1) / (c.sum("seen") + 2)
    model.starts = {w: max(-6.0, min(3.0, math.log((c.opens[w] + 0.5 * part) / ((n + 0.5) * part)))) for w, n in c.seen.items() if n >= 3}
    if c.joins_l:
        n, k = c.sum("joins_l"), c.sum("in_l")
        ratio = lambda a, b: max(-3.0, min(3.0, math.log((a + 0.5) / (n + 50)) - math.log((b + 0.5) / (k + 50))))
        left, right = model.runs = ({x: ratio(c.joins_l[x], c.in_l[x]) for x in c.in_l}, {x: ratio(c.joins_r[x], c.in_r[x]) for x in c.in_r})
        rows = []
        for text in filter(_HAS_RUNS, texts):
            whole = stripped_paragraphs(text)
            for p, q in zip(whole, whole[1:]):
                rows.append((left.get(p[-2:], 0.0), right.get(q[:1], 0.0), 1.0))
            rows += [(left.get(p[max(0, i - 2) : i], 0.0), right.get(p[i], 0.0), 0.0) for p in whole for i in range(1, len(p))]
        x = np.array(rows)
        if len(x) and x[:, 2].any():
            model.run_weights = tuple(float(v) for v in _logistic(x[:, :2], x[:, 2], RUN_PRIOR, rounds, pull))
    if examples:
        names = sorted({x for fs, _, _ in examples for x in fs})
        at = {x: i for i, x in enumerate(names)}
        rows, cols = [], []
        for r, (fs, _, _) in enumerate(examples):
            for x in fs:
                rows.append(r)
                cols.append(at[x])
        rows, cols = np.array(rows), np.array(cols)
        base = np.array([model.word_score(w) if w else 0.0 for _, w, _ in examples])
        y = np.array([v for _, _, v in examples])
        prior = np.array([PRIOR.get(x, 0.0) for x in names])
        w = prior.copy()
        for _ in range(rounds):
            z = base + np.bincount(rows, w[cols], len(y))
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            w -= 0.5 * (np.bincount(cols, g[rows], len(names)) / len(y) * 4 + pull * (w - prior))
        model.weights |= {x: float(v) for x, v in zip(names, w)}
    return model


def sample_texts(df: DataFrame, key: str, text: str = "text", size: int = SAMPLE) -> list[str]:
    """Whole texts of the bounded sample: about `size` rows, those whose hash of key and text is in the share wanted.

    Only the sample's texts leave their tasks, and never more than twice `size`.
    """
    share = size / max(1, df.count())
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    chosen = src if share >= 1 else src.where(F.pmod(F.xxhash64("k", "t"), F.lit(1 << 40)) < int(share * (1 << 40)))
    return [r[0] for r in chosen.where(F.length("t") > 0).select("t").limit(2 * size).collect()]


def sentence_units(df: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """One row per unit: key, unit_no (from 1), start_char, end_char.

    start_char is where the unit's first visible character stands, end_char counts characters up to and including
    its last. Null, empty and blank texts give no rows; a repeated row gives its units again. Other columns are
    ignored. Without a model, one is fitted on counts over this table and on a bounded sample of it.
    """
    shared = df.sparkSession.sparkContext.broadcast(model or fit(sorted(sample_texts(df, key, text)), corpus_counts(df, text)))
    src = df.select(F.col(key).alias(key), F.col(text).alias("_body")).where(F.length("_body") > 0)
    fields = [T.StructField("unit_no", T.IntegerType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())]
    first = re.compile(rf"[\s{_BLIND}]*")

    def make():
        model = shared.value

        def f(texts: pa.Array):
            index, no, a, b = [], [], [], []
            for i, t in enumerate(texts.to_pylist()):
                low = 0
                for k, e in enumerate(model.decode(t), 1):
                    index.append(i)
                    no.append(k)
                    a.append(first.match(t, low).end())
                    b.append(e)
                    low = e
            return index, [pa.array(x, pa.int32()) for x in (no, a, b)]

        return f

    return explode_rows(src, [key], ["_body"], fields, make)
