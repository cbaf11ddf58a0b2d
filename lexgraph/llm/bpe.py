"""Byte-level BPE as a lazily determinised finite-state transducer.

The merge list is compiled into a trie of token bytes and the split of each token. The transducer reads bytes and
keeps, for every place where a token could still begin, the chain of tokens before that place which isn't common to
all of them; what is common is emitted. The chain of each prefix is unique (the token that ends a prefix is the one
compatible with the last token of what is before it), so the look-ahead is bounded by the longest token. States
and transitions are made on first use and forgotten when there are too many, like those of a lazy DFA.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.arrowmap import add_columns
from ..runtime import tokenizer_path

#: Most transitions, pieces and pairs of tokens a task remembers; beyond that it starts again, which changes no result.
MOST_TRANSITIONS, MOST_PIECES, MOST_FITS = 3_000_000, 400_000, 1_000_000

#: The pre-tokenisation pattern of this family of public tokenizers (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself if printable Latin-1, else from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Splitter:
    """Cuts a text into pieces as PATTERN does.

    The standard library's engine is several times faster than the one that knows \\p{...}; its classes differ only
    in letter-like numbers and four control characters, so texts with those take the exact engine.
    """

    def __init__(self) -> None:
        import regex

        odd = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("No", "Nl")]
        self.exact = regex.compile(PATTERN).findall
        self.fast = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
        runs: list[list[int]] = []
        for c in map(ord, odd):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        self.odd = re.compile("[\x1c-\x1f" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs) + "]").search

    def __call__(self, text: str) -> list[str]:
        return self.exact(text) if self.odd(text) else self.fast(text)


class Transducer:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = _byte_chars()
        ids: dict[str, int] = model["vocab"]
        self.bytes: dict[int, bytes] = {}
        for s, i in ids.items():
            if all(ch in to_byte for ch in s):
                self.bytes[i] = bytes(to_byte[ch] for ch in s)
        self.split: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.order: dict[int, int] = {}
        for n, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair, whole = (ids[a], ids[b]), ids[a + b]
            self.rank.setdefault(pair, n)
            if whole not in self.split:
                self.split[whole], self.order[whole] = pair, n
        # The trie: children of each node by byte, and the token that ends there.
        self.kids: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        usable = [i for i in self.bytes if i in self.split or len(self.bytes[i]) == 1]
        for i in usable:
            at = 0
            for b in self.bytes[i]:
                nxt = self.kids[at].get(b)
                if nxt is None:
                    nxt = self.kids[at][b] = len(self.kids)
                    self.kids.append({})
                    self.token.append(-1)
                at = nxt
            self.token[at] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.states: dict[tuple, int] = {}
        self.about: list[tuple] = []
        self.next: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.start = self._state((-1, ((0, ()),)))

    def _state(self, what: tuple) -> int:
        n = self.states.get(what)
        if n is None:
            n = self.states[what] = len(self.about)
            self.about.append(what)
        return n

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: no merge across their border comes before those that made them."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > MOST_FITS:
                self.fits.clear()
            known = self.fits[(a, b)] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo merges from the latest on; whenever the pieces at the border could merge earlier than the merge
        # undone last, the two tokens would not have come about side by side.
        right_a, left_b, limit = a, b, 1 << 60
        while True:
            r = self.rank.get((right_a, left_b))
            if r is not None and r < limit:
                return False
            ra, lb = self.order.get(right_a, -1), self.order.get(left_b, -1)
            if ra < 0 and lb < 0:
                return True
            # On equal terms the left merge comes first, so the right one is undone first.
            if ra > lb:
                limit, right_a = ra, self.split[right_a][1]
            else:
                limit, left_b = lb + 1, self.split[left_b][0]

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, alive = self.about[state]
        after, ended = [], None
        for node, before in alive:
            child = self.kids[node].get(byte)
            if child is None:
                continue
            t = self.token[child]
            if t >= 0 and ended is None:
                previous = before[-1] if before else last
                if previous < 0 or self.compatible(previous, t):
                    ended = (*before, t)
            if self.kids[child]:
                after.append((child, before))
        if ended is None:
            raise ValueError("a byte outside the vocabulary")
        after.append((0, ended))
        common = 0
        shortest = min(len(c) for _, c in after)
        first = after[0][1]
        while common < shortest and all(c[common] == first[common] for _, c in after):
            common += 1
        out = first[:common]
        if common:
            last, after = first[common - 1], [(n, c[common:]) for n, c in after]
        got = self.next[state << 8 | byte] = (self._state((last, tuple(after))), out)
        return got

    def piece(self, data: bytes) -> tuple[int, ...]:
        """Ids of one piece of a text."""
        if len(self.next) > MOST_TRANSITIONS:
            self._forget()
        state, out, known = self.start, [], self.next
        for b in data:
            got = known.get(state << 8 | b)
            state, emitted = got if got is not None else self._step(state, b)
            if emitted:
                out += emitted
        out += next(c for n, c in self.about[state][1] if n == 0)
        return tuple(out)


class Encoder(dict):
    """Text to ids; the ids of pieces seen before are kept."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.fst, self.split = Transducer(path), Splitter()

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > MOST_PIECES:
            self.clear()
        got = self[piece] = self.fst.piece(piece.encode("utf-8", "surrogatepass"))
        return got

    def ids(self, text: str) -> Iterator[int]:
        return chain.from_iterable(map(self.__getitem__, self.split(text)))

    def count(self, text: str) -> int:
        return sum(map(len, map(self.__getitem__, self.split(text))))


def decode_stream(ids: Iterable[int], vocabulary: dict[int, bytes]) -> Iterator[str]:
    """Text of a stream of ids, as soon as it is certain: an incremental UTF-8 automaton over the tokens' bytes.

    Ill-formed sequences become U+FFFD, one for each maximal part that begins a character.
    """
    need, value, low, high = 0, 0, 0x80, 0xBF
    for i in ids:
        out = []
        for b in vocabulary[i]:
            if need:
                if low <= b <= high:
                    need, value, low, high = need - 1, value << 6 | b & 0x3F, 0x80, 0xBF
                    if not need:
                        out.append(chr(value))
                    continue
                out.append("�")
                need, low, high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                need, value = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                need, value = 2, b & 0x0F
                low, high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                need, value = 3, b & 0x07
                low, high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        if out:
            yield "".join(out)
    if need:
        yield "�"


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """Add the token ids of a text column, a list of integers without special tokens.

    Null and empty texts give an empty list. One output row per input row; other columns stay, one named like `out`
    is replaced. Texts of any length are encoded whole.
    """
    path = path or tokenizer_path()

    def make():
        enc = Encoder(path)

        def f(texts: pa.Array) -> list[pa.Array]:
            import array

            values, ends = array.array("i"), array.array("i", [0])
            for t in texts.to_pylist():
                if t:
                    values.extend(enc.ids(t))
                ends.append(len(values))
            return [pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(values), pa.int32()))]

        return f

    return add_columns(df, [text], [T.StructField(out, T.ArrayType(T.IntegerType(), False))], make)


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """Add the number of tokens of a text column; 0 for null and empty texts."""
    path = path or tokenizer_path()

    def make():
        enc = Encoder(path)
        return lambda texts: [pa.array([enc.count(t) if t else 0 for t in texts.to_pylist()], pa.int64())]

    return add_columns(df, [text], [T.StructField(out, T.LongType())], make)


def decode(df: DataFrame, ids: str = "ids", out: str = "text", path: str | None = None) -> DataFrame:
    """Add the text of a list of ids; null for a null list."""
    path = path or tokenizer_path()

    def make():
        vocabulary = Transducer(path).bytes
        return lambda lists: [pa.array([None if x is None else "".join(decode_stream(x, vocabulary)) for x in lists.to_pylist()], pa.string())]

    return add_columns(df, [ids], [T.StructField(out, T.StringType())], make)
