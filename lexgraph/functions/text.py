"""Column functions for text, URLs, numbers and JSON; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(c: Column) -> Column:
    """White space of any kind collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def norm_words(c: Column) -> Column:
    """Lower case, everything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def compact_code(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def is_blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def contains_any(columns: list[Column], q: str) -> Column:
    """Case-insensitive substring search over several columns; % and _ in q stand for themselves."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q.lower())) for c in columns])


def json_true(c: Column, path: str) -> Column:
    """JSON true or 1 at a path; null, malformed JSON and anything else is false."""
    return F.coalesce(F.lower(F.get_json_object(c, path)).isin("true", "1"), F.lit(False))


def roman_to_int(c: Column) -> Column:
    """Value of a roman numeral; null if the text isn't one."""
    values = F.create_map(*(F.lit(x) for p in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in p))
    numbers = F.transform(F.reverse(F.split(F.upper(F.trim(c)), "")), lambda s: values[s])
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    step = lambda a, v: F.struct((F.when(v < a["last"], a["total"] - v).otherwise(a["total"] + v)).alias("total"), F.greatest(v, a["last"]).alias("last"))
    return F.when(F.upper(F.trim(c)).rlike("^[IVXLCDM]+$"), F.aggregate(numbers, start, step)["total"])


def column_number(c: Column) -> Column:
    """Spreadsheet column letters as a number: A is 1, AA is 27; null for other texts."""
    letters = F.split(F.upper(c), "")
    return F.when(F.upper(c).rlike("^[A-Z]+$"), F.aggregate(letters, F.lit(0).cast("long"), lambda a, s: a * 26 + (F.ascii(s) - 64)))


def snippet(text: Column, q: str, size: int = 240, lead: int = 80) -> Column:
    """A window of the text that starts a little before the first word of the query."""
    first = (q.split() or [""])[0].lower()
    at = F.greatest(F.locate(first, F.lower(text)) - 1 - lead, F.lit(0)) if first else F.lit(0)
    return F.substring(text, at.cast("int") + 1, F.lit(size))


def evidence_window(text: Column, pattern: str, pad: int = 90) -> Column:
    """The first match of a pattern with its surroundings, white space collapsed; null without a match."""
    at = F.regexp_instr(text, F.lit(pattern))
    hit = F.regexp_substr(text, F.lit(pattern))
    start = F.greatest(at - pad, F.lit(1))
    return F.when(at > 0, clean_text(F.substring(text, start.cast("int"), (at - start + F.length(hit) + pad).cast("int"))))


def normalise_url(c: Column) -> Column:
    """Scheme and host in lower case, no fragment, no trailing slash, no tracking parameters, the others sorted."""
    no_fragment = F.regexp_replace(F.trim(c), "#.*$", "")
    base = F.regexp_replace(no_fragment, r"\?.*$", "")
    origin = F.lower(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1))
    path = F.regexp_replace(F.regexp_replace(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), "/+$", "")
    query = F.regexp_extract(no_fragment, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_|download=)")))
    return F.when(F.length(F.trim(c)) > 0, F.concat(origin, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def ladder(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The label of the first rule that holds."""
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for condition, label in rules[1:]:
        out = out.when(condition, F.lit(label))
    return out.otherwise(F.lit(default)) if default is not None else out
