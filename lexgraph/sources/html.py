"""Pages to nodes: headings, paragraphs, list items and table rows with their path of headings, by the standard
library's parser, a batch of pages at a time."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.arrowmap import explode_rows

_BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "pre", "dt", "dd", "div"}
_SKIP = {"script", "style", "nav", "head", "noscript"}


class _Spans(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str, str, str]] = []
        self.heads: list[tuple[int, str]] = []
        self.kind, self.text, self.anchor, self.skip = "", [], "", 0

    def _flush(self) -> None:
        body = " ".join("".join(self.text).split())
        if body:
            if self.kind[:1] == "h" and self.kind[1:].isdigit():
                level = int(self.kind[1:])
                self.heads = [h for h in self.heads if h[0] < level] + [(level, body)]
                span = "heading"
            else:
                span = {"li": "item", "td": "row", "th": "row", "pre": "code"}.get(self.kind, "paragraph")
            self.out.append((span, " > ".join(t for _, t in self.heads), self.anchor, body))
        self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _SKIP:
            self.skip += 1
        elif tag in _BLOCKS:
            self._flush()
            self.kind, self.anchor = tag, dict(attrs).get("id") or ""

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in _BLOCKS:
            self._flush()
            self.kind, self.anchor = "", ""

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)


def page_spans(html: str) -> list[tuple[str, str, str, str]]:
    """(span_type, heading_path, anchor, text) in the page's order."""
    p = _Spans()
    p.feed(html)
    p.close()
    p._flush()
    return p.out


def parse_pages(df: DataFrame, key: str = "id", html: str = "raw_html") -> DataFrame:
    """key, span_no, span_type, heading_path, anchor, text; null and empty pages give no rows."""
    fields = [T.StructField("span_no", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("span_type", "heading_path", "anchor", "text"))]

    def make() -> Callable:
        def f(pages: pa.Array):
            index, no, cols = [], [], ([], [], [], [])
            for i, page in enumerate(pages.to_pylist()):
                for k, span in enumerate(page_spans(page) if page else [], 1):
                    index.append(i)
                    no.append(k)
                    for c, v in zip(cols, span):
                        c.append(v)
            return index, [pa.array(no, pa.int32()), *(pa.array(c, pa.string()) for c in cols)]

        return f

    return explode_rows(df.select(key, html), [key], [html], fields, make)
