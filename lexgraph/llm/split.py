"""Splitting oversized items at natural boundaries by lexical cohesion.

Every natural boundary of a text gets the similarity of the blocks of words before and after it. Valleys of this
curve mark a change of topic; each piece ends at the deepest valley in its size window and the next one starts
about `overlap` characters earlier.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from math import sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrowmap import explode_rows

LIMIT, OVERLAP = 1800, 150
#: Words in the block on either side of a boundary.
BLOCK = 40

#: Kinds of boundary, from the strongest: paragraph, item, sentence, word.
PARAGRAPH, ITEM, SENTENCE, WORD = 3, 2, 1, 0

_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_ITEM = re.compile(r"\n\s*(?=(?:[-–—•*·▪‣]|\(?(?:\d{1,3}(?:\.\d{1,3})*|[A-Za-z]|[ivxIVX]{1,5})[.)]|\d{1,3}(?:\.\d{1,3})+)[^\S\n])")
_SENTENCE = re.compile(r"[.!?…।॥؟۔:;][\"'”’»)\]]*\s+|[。！？；][」』”’）]*\s*|\n\s*")
_WORD = re.compile(r"\s+")
_TOKEN = re.compile(r"[^\W\d_]+")


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Places where a unit starts (after the white space), in order, and the strongest kind of each."""
    kind: dict[int, int] = {}
    for k, pattern in ((SENTENCE, _SENTENCE), (ITEM, _ITEM), (PARAGRAPH, _PARAGRAPH)):
        for m in pattern.finditer(text):
            kind[m.end()] = k
    kind.pop(0, None)
    kind.pop(len(text), None)
    at = sorted(kind)
    return at, [kind[i] for i in at]


def _tokens(text: str) -> tuple[list[str], list[int]]:
    """Words in lower case and where they start; long runs (scripts without spaces) count by pairs of characters."""
    words, starts = [], []
    for m in _TOKEN.finditer(text):
        w, i = m[0].lower(), m.start()
        if w.isascii() or len(w) <= 3:
            words.append(w)
            starts.append(i)
        elif ord(w[0]) >= 0x0E00:
            for j in range(len(w) - 1):
                words.append(w[j : j + 2])
                starts.append(min(i + j, i + len(m[0]) - 1))
        else:
            words.append(w)
            starts.append(i)
    return words, starts


def depths(text: str, at: list[int], block: int = BLOCK) -> list[float]:
    """How deep the valley of lexical cohesion is at each boundary; linear in the text."""
    words, starts = _tokens(text)
    sims = []
    for i in at:
        k = bisect_left(starts, i)
        a, b = Counter(words[max(0, k - block) : k]), Counter(words[k : k + block])
        dot = sum(n * b[w] for w, n in a.items() if w in b)
        sims.append(dot / sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if a and b else 0.0)
    left, right = sims[:], sims[:]
    for i in range(1, len(sims)):
        if sims[i - 1] >= sims[i]:
            left[i] = left[i - 1]
    for i in range(len(sims) - 2, -1, -1):
        if sims[i + 1] >= sims[i]:
            right[i] = right[i + 1]
    return [x + y - 2 * s for x, y, s in zip(left, right, sims)]


def _word_start(text: str, low: int, high: int, near: int) -> int | None:
    """The start of a word in (low, high] that is nearest to `near`."""
    found = [m.end() for m in _WORD.finditer(text, max(0, low - 1), min(len(text), high + 1)) if low < m.end() <= high]
    return min(found, key=lambda i: (abs(i - near), i)) if found else None


def _whole_character(text: str, at: int, low: int) -> int:
    """Move a forced cut back so that it doesn't part a base character from its marks."""
    i = at
    while i > low + 1 and i < len(text) and (unicodedata.category(text[i]) in ("Mn", "Mc", "Me") or text[i] == "‍" or text[i - 1] == "‍"):
        i -= 1
    return i if i > low + 1 else at


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK) -> list[tuple[int, int]]:
    """(start, end) of each piece. One piece if the text is within the limit; every character is in some piece."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    at, kind = boundaries(text)
    depth = depths(text, at, block)
    least = max(limit // 2, min(overlap * 2, limit - 1))
    pieces, start = [], 0
    while n - start > limit:
        end = None
        for low in (start + least, start + overlap):
            i, j = bisect_right(at, low), bisect_right(at, start + limit)
            if i < j:
                end = at[max(range(i, j), key=lambda k: (round(depth[k], 6), kind[k], at[k]))]
                break
        if end is None:
            end = _word_start(text, start + overlap, start + limit, start + limit)
        if end is None:
            end = _whole_character(text, start + limit, start + overlap)
        pieces.append((start, end))
        back = max(start + 1, end - overlap)
        nearest = _word_start(text, max(start, back - overlap // 4 - 1), min(end - 1, back + overlap // 4), back)
        start = nearest if nearest is not None else _whole_character(text, back, start)
    pieces.append((start, n))
    return pieces


def latest(df: DataFrame, key: str, loaded: str | None) -> DataFrame:
    """The latest delivery of each key (of two at one time always the same); rows with a null key stay as they are."""
    if loaded is None:
        return df
    # A number for each row without a key, so that those rows spread over all tasks.
    own = df.withColumn("_own", F.when(F.col(key).isNull(), F.monotonically_increasing_id()))
    first = F.row_number().over(W.partitionBy(key, "_own").orderBy(F.col(loaded).desc_nulls_last(), F.xxhash64("body")))
    return own.withColumn("_nth", first).where("_nth = 1").drop("_nth", "_own")


def oversized(text: Column, limit: int = LIMIT) -> Column:
    return F.char_length(text) > limit


def split_oversized(df: DataFrame, item_table: str, key: str, text: str, loaded: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of each item longer than `limit` characters: item_table, item_id, piece_no, start_char, end_char, piece.

    Pieces are at most `limit` characters, numbered from 1, and cover the text; each but the first repeats about the
    last `overlap` characters of the one before. Items within the limit, null and empty texts give no rows; of
    several deliveries of one id (where `loaded` names their time) the latest oversized one counts, otherwise a
    repeated row gives its pieces again. Ties of valley depth go to the stronger, then the later boundary. Other
    columns are ignored, whatever their names.
    """
    src = df.select(F.lit(item_table).alias("item_table"), F.col(key).cast("string").alias("item_id"), F.col(text).alias("body"), *([F.col(loaded).alias("at")] if loaded else []))
    big = latest(src.where(oversized(F.col("body"), limit)), "item_id", "at" if loaded else None)
    fields = [T.StructField("piece_no", T.IntegerType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()), T.StructField("piece", T.StringType())]

    def make():
        def f(texts: pa.Array):
            index, no, a, b, out = [], [], [], [], []
            for i, t in enumerate(texts.to_pylist()):
                for k, (s, e) in enumerate(split_text(t, limit, overlap), 1):
                    index.append(i)
                    no.append(k)
                    a.append(s)
                    b.append(e)
                    out.append(t[s:e])
            return index, [pa.array(no, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(out, pa.string())]

        return f

    return explode_rows(big, ["item_table", "item_id"], ["body"], fields, make)
