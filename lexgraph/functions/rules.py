"""Column functions for names, numbers, dates, versions and labels, by ladders and patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, ladder


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def url_path(c: Column) -> Column:
    """The path of a URL without scheme, host, query and fragment."""
    return F.regexp_replace(F.regexp_replace(_text(c), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")


def cache_name(c: Column) -> Column:
    """The name of the file that a page is kept in: its path and query with file-safe separators."""
    path = F.regexp_replace(F.regexp_replace(url_path(c), "^/+|/+$", ""), "/", "__")
    query = F.translate(F.regexp_extract(_text(c), r"\?([^#]*)", 1), "&=", "_-")
    return F.concat(F.when(path == "", "index").otherwise(path), F.when(query != "", F.concat(F.lit("__"), query)).otherwise(""), F.lit(".html"))


def canonical_url(c: Column) -> Column:
    """The URL with its host in lower case and without its fragment; the query stays."""
    origin = F.regexp_extract(_text(c), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.concat(F.lower(origin), F.regexp_replace(F.substr(_text(c), F.length(origin) + 1), "#.*$", ""))


def safe_name(url: Column) -> Column:
    """A file name for a download: the path's last name, an id of the canonical URL, and its ending (else .html)."""
    name = F.regexp_extract(url_path(url), r"([^/]*)/*$", 1)
    name = F.when(name == "", "index").otherwise(name)
    ending = F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))
    stem = F.when(ending != "", F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    stem = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "-"), r"^[-._]+|[-._]+$", "")
    key = F.substring(F.sha1(canonical_url(url)), 1, 16)
    return F.concat(F.when(F.substring(stem, 1, 110) != "", F.substring(stem, 1, 110)).otherwise(key), F.lit("-"), key, F.when((ending == "") | (F.length(ending) > 8), ".html").otherwise(ending))


def document_version(url: Column) -> Column:
    """The number of a `-vN` mark before a file's ending, else 0."""
    return F.coalesce(F.regexp_extract(F.lower(_text(url)), r"-v(\d+)\.[a-z0-9]+(?:[?#]|$)", 1).try_cast("int"), F.lit(0))


def package_version(url: Column) -> Column:
    """(major, minor, patch, hotfix) of a taxonomy package's URL; null without a version."""
    u = F.lower(_text(url))
    dotted, packed = r"banking[_-](\d+)\.(\d+)\.(\d+)", r"banking[-_]?v?(\d)(\d)(\d)"
    part = lambda g: F.when(u.rlike(dotted), F.regexp_extract(u, dotted, g)).otherwise(F.regexp_extract(u, packed, g)).try_cast("int")
    made = F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), F.contains(u, F.lit("hotfix")).cast("int").alias("hotfix"))
    return F.when(u.rlike(dotted) | u.rlike(packed), made)


def confidence_number(c: Column) -> Column:
    """A confidence given as a number or a label; 0 for anything else."""
    t = F.lower(F.trim(_text(c)))
    return F.coalesce(F.when(t.isin("very high", "high"), 0.9).when(t == "medium", 0.65).when(t == "low", 0.35), t.try_cast("double"), F.lit(0.0))


def template_number(c: Column) -> Column:
    """The number of a template's code, without its letters and trailing zeros; empty without one."""
    t = F.translate(F.regexp_replace(F.trim(_text(c)), "^[A-Za-z_ -]+", ""), "_", ".")
    plain = F.regexp_replace(F.format_string("%.6f", t.try_cast("double")), r"\.?0+$", "")
    return F.when(t.rlike(r"^\d+(\.\d+)?$"), plain).otherwise(F.regexp_extract(t, r"(\d+(?:\.\d+)*)", 1))


def iso_date(c: Column) -> Column:
    """The first date of this century in ISO form that a text holds."""
    return F.nullif(F.regexp_extract(_text(c), r"(20\d{2}-\d{2}-\d{2})", 1), F.lit(""))


def written_dates(c: Column) -> Column:
    """Every dd/mm/yyyy of a text, in its order."""
    return F.regexp_extract_all(_text(c), F.lit(r"\b\d{2}/\d{2}/\d{4}\b"), F.lit(0))


def link_status(url: Column, final_url: Column, status: Column, text: Column, error: Column) -> Column:
    """ok, broken, suspect, soft_404 or error: what a link check found."""
    ending = lambda c: F.lower(F.regexp_extract(url_path(c), r"(\.[A-Za-z0-9]+)$", 1))
    either = lambda *e: ending(url).isin(*e) | ending(final_url).isin(*e)
    soft = F.lower(F.substring(_text(text), 1, 5000)).rlike(r"page not found|not found|\b404\b")
    return ladder([(_text(error) != "", "error"), (status.isNull(), "error"), ((status == 403) & either(".pdf", ".xlsx"), "ok"), ((status == 403) & either(".aspx"), "broken"), (status.isin(404, 410), "broken"), (status >= 400, "suspect"), (soft, "soft_404")], "ok")


def page_line(c: Column) -> Column:
    """A line of a page without white space at its ends; empty for page numbers and running titles."""
    t = clean_text(_text(c))
    return F.when(t.rlike(r"^\d+$") | t.rlike(r"(?i)^PRA\s+(Supervisory Statement|Statement of Policy)\b") | t.rlike(r"(?i)^Bank of England\s+\|"), "").otherwise(t)


def link_title(c: Column) -> Column:
    """A link's text without marks of new windows, file types and sizes."""
    t = clean_text(_text(c))
    for p in (r"\s*\*+\s*$", r"(?i)\s+opens in a new window\s*$", r"(?i)\s*[\[(]\s*(?:pdf|xlsx|xls|zip|html)\s*[\])]\s*[\[(]\s*[\d.]+\s*(?:kb|mb|gb)\s*[\)]\s*$", r"(?i)\s*[\[(]?\s*(?:pdf|xlsx|xls|zip|html)(?:\s+[\d.]+\s*(?:kb|mb|gb))?\s*[\])]\s*$"):
        t = F.regexp_replace(t, p, "")
    return F.regexp_replace(t, "^[ –—-]+|[ –—-]+$", "")


def return_code(c: Column) -> list[Column]:
    """Sort columns of a return's code: letters, number (the largest if there is none), rest."""
    t = _text(c)
    whole = r"^([A-Z]+)(\d*)(.*)$"
    number = F.regexp_extract(t, whole, 2).try_cast("long")
    return [F.when(t.rlike("^[A-Z]"), F.regexp_extract(t, whole, 1)).otherwise(t).alias("prefix"), F.coalesce(number, F.lit(2**53 - 1)).alias("number"), F.regexp_extract(t, whole, 3).alias("suffix")]


def unresolved_reason(kind: Column, text: Column, ident: Column, doc: Column) -> Column:
    """Why a reference is left unresolved on purpose; null if it isn't."""
    hay = F.concat_ws(" ", _text(text), _text(ident), _text(doc))
    plain = lambda c: F.trim(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", " "))
    h = plain(hay)
    generic = ("pra rulebook", "part of pra rulebook", "part of the pra rulebook", "the pra rulebook", "crr", "regulation", "that regulation", "this implementing regulation", "implementing regulation")
    relative = hay.rlike(r"(?i)\b(that|this|these|thereof|relevant|applicable)\b") & hay.rlike(r"(?i)\b(Regulation|Directive|Part|Article|Annex|standard|rule)\b")
    return ladder([(F.length(h) <= 2, "noisy_fragment"), (F.size(F.split(_text(kind), r"\|")) >= 6, "ambiguous_kind"), (h.isin(*generic), "generic_reference"), (relative, "relative_reference"), (plain(kind).isin("unknown", "reference", "definition", "paragraph", "namespace"), "low_value_reference"), (h.rlike(r"^[a-z]?\(?[a-z0-9]{1,3}\)?$"), "noisy_fragment")])
