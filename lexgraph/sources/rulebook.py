"""Pages of a rulebook site to nodes and edges: indexes, Parts, guidance, glossaries, lists of terms and instruments.

A page is read once by the standard library's parser into a light tree. One walk turns it into rows - chapters, headings
and row blocks with their number, body and anchor - and each kind of page says how its rows become nodes. Pages are
parsed a batch at a time; what they give is one table of records, from which nodes and edges are taken.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import pick
from ..runtime import cut

#: Forms of numbers, dates and links on the pages (fixed values).
RULE_NUMBER = re.compile(r"^\d+[A-Z]?(?:\.\d+[A-Z]?)*$")
PARAGRAPH_NUMBER = re.compile(r"^(?:[A-Z]\.?)?\d+[A-Z]?(?:\.\d+[A-Z]?)*$")
DATE = re.compile(r"\b\d{2}/\d{2}/\d{4}\b")
GLOSSARY_HASH = re.compile(r"#glossary-term-?([\w-]+)|#([0-9a-f]{32})\b")
INSTEAD = re.compile(r"^(?:means|includes|has the meaning|is|are)\b", re.I)
LISTINGS = {"", "crr-firms", "non-crr-firms", "sii-firms", "non-sii-firms", "non-authorised-persons", "forms"}
CATEGORIES = ("CRR Firms", "Non-CRR Firms", "SII Firms", "Non-SII Firms", "Non-authorised Persons")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


@dataclass
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    inside: list[Element | str] = field(default_factory=list)

    @property
    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def walk(self) -> Iterator[Element]:
        """The elements below, in the page's order."""
        todo = [*reversed(self.inside)]
        while todo:
            e = todo.pop()
            if isinstance(e, Element):
                yield e
                todo.extend(reversed(e.inside))

    def lines(self) -> list[str]:
        """The pieces of text, white space collapsed, without empty ones."""
        out, todo = [], [self]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                out.append(" ".join(e.split()))
            else:
                todo.extend(reversed(e.inside))
        return [x for x in out if x]

    @property
    def text(self) -> str:
        return " ".join(self.lines())

    def first(self, *classes: str, tags: tuple[str, ...] = (), without: str = "") -> Element | None:
        for e in self.walk():
            if (not tags or e.tag in tags) and set(classes) <= e.classes and (not without or without not in e.classes):
                return e
        return None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("root")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].inside.append(e)
        if tag not in _VOID:
            self.open.append(e)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        self.open[-1].inside.append(data)


def tree(html: str) -> Element:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def node_key(stable: str) -> str:
    return hashlib.sha1(stable.encode()).hexdigest()[:16]


def edge_key(*parts: str) -> str:
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:20]


def display_number(number: str, article: str) -> str:
    """A provision's number as it is cited: within an article or annex, each level in brackets."""
    return article + "".join(f"({p})" for p in number.split(".") if p) if article else number


class Site:
    """What a page gives: records of nodes and edges, each id once."""

    def __init__(self, url: str) -> None:
        self.url = url
        self.records: dict[str, dict] = {}

    def node(self, kind: str, stable: str, title: str, text: str = "", url: str | None = None, **metadata) -> str:
        i = node_key(stable)
        self.records.setdefault("n" + i, {"record": "node", "id": i, "kind": kind, "stable_key": stable, "title": title, "text": text, "url": self.url if url is None else url, "metadata_json": json.dumps(metadata, ensure_ascii=False)})
        return i

    def edge(self, a: str, b: str, kind: str, method: str, *extra: str, confidence: float = 1.0, evidence: str = "", **metadata) -> None:
        i = edge_key(a, b, kind, *extra)
        self.records.setdefault("e" + i, {"record": "edge", "id": i, "kind": kind, "from_node_id": a, "to_node_id": b, "source_method": method, "confidence": confidence, "evidence_text": evidence, "url": self.url, "metadata_json": json.dumps(metadata, ensure_ascii=False)})

    def path(self, url: str | None = None) -> str:
        return urlsplit(self.url if url is None else url).path.strip("/")

    def links(self, owner: str, body: Element) -> None:
        """Links of a body: to terms, to rules of the site, to anything else."""
        for a in body.walk():
            href = a.attrs.get("href", "")
            if a.tag != "a" or not href or href.startswith(("mailto:", "tel:")):
                continue
            full, text = urljoin(self.url, href), a.text
            term = GLOSSARY_HASH.search(href)
            if term:
                name = " ".join((a.attrs.get("title") or text).split())
                target = f"defined_term:glossary:{name.lower()}" if name else f"glossary-term:{term[1] or term[2]}"
                self.edge(owner, node_key(target), "uses_defined_term", "html_glossary_link", href, evidence=name or text, href=href, target_key=target)
            elif href.startswith("/pra-rules/"):
                part = urlsplit(full)
                target = f"url:{part.path.strip('/')}" + (f"#{part.fragment}" if part.fragment else "")
                self.edge(owner, node_key(target), "references", "html_link", href, evidence=text, href=full, target_key=target)
            elif href.startswith(("/", "http")):
                self.edge(owner, node_key(f"external:{full}"), "references", "html_link", href, confidence=0.8, evidence=text, href=full, target_key=f"external:{full}")

    def inline_definitions(self, owner: str, title: str, body: Element, part: str, part_title: str) -> None:
        """A block that is hardly more than a linked term, followed by one that says what it means."""
        blocks = [b for b in body.walk() if b.tag in ("p", "li") and b.text]
        for block, after in zip(blocks, blocks[1:]):
            link = next((a for a in block.walk() if a.tag == "a" and ("glossary-link" in a.classes or GLOSSARY_HASH.search(a.attrs.get("href", "")))), None)
            name = " ".join((link.attrs.get("title") or link.text).split()) if link else ""
            if name and len(block.text) <= len(name) + 8 and INSTEAD.match(after.text):
                stable = f"defined_term:part:{part}:{name.lower()}"
                term = self.node("defined_term", stable, name, after.text, source="inline_part_definition", part_title=part_title, rule_id=owner, rule_title=title)
                for kind in ("defines", "uses_defined_term"):
                    self.edge(owner, term, kind, "inline_part_definition", stable, evidence=name, part_title=part_title)


def _rows(page: Element) -> Iterator[tuple[str, str, str, Element | None, str, Element]]:
    """(kind, number, heading, body, anchor, element) of the chapters and row blocks of a page, in their order."""
    for e in page.walk():
        if e.tag == "div" and "chapter-section" in e.classes:
            number, heading = e.first("chapter-number"), e.first("chapter-heading")
            yield "chapter", number.text if number else "", heading.text if heading else "", None, e.attrs.get("id", ""), e
        elif e.tag == "div" and "row-block" in e.classes:
            number, heading = e.first("rule-number", without="chapter-number"), e.first(tags=("h2", "h3", "h4"))
            yield "row", number.text.rstrip(".") if number else "", heading.text if heading else "", e.first("div-row__col-2"), e.attrs.get("id", ""), e


def _title(site: Site, page: Element) -> str:
    h1 = page.first(tags=("h1",))
    names = [x for x in site.path().split("/") if x]
    return h1.text if h1 else names[-2] if len(names) > 1 else names[-1] if names else ""


def _date(page: Element) -> str | None:
    content = page.first("rulebook-content")
    if content and content.attrs.get("data-rulebook-date"):
        return content.attrs["data-rulebook-date"]
    found = DATE.search(page.text)
    return found[0] if found else None


def read_part(site: Site, page: Element) -> None:
    """A Part: its chapters, headings and rules with links and inline definitions."""
    title, key = _title(site, page), f"part:{site.path()}"
    part = site.node("part", key, title, rulebook_date=_date(page))
    chapter, numbered, article, tail, chapter_title = part, True, "", "", ""
    for kind, number, heading, body, anchor, e in _rows(page.first("rulebook-content") or page):
        at = f"{site.url}#{anchor}"
        if kind == "chapter":
            chapter_title = heading or f"Chapter {number}"
            tail = number or f"{chapter_title.lower()}:{anchor}"
            found = re.match(r"(?:Article\s+\d+[A-Za-z]*|Annex\s+[IVXLCDM]+)\b", chapter_title, re.I)
            article, numbered = found[0] if found else "", bool(number)
            chapter = site.node("chapter", f"chapter:{key}:{tail}", chapter_title, url=at, chapter_number=number, article_number=article, part_title=title, html_id=anchor)
            site.edge(part, chapter, "contains", "site_structure")
            continue
        block = body or e
        if RULE_NUMBER.match(number):
            within = "" if numbered else f":{tail.rsplit(':', 1)[-1]}"
            shown = display_number(number, article)
            rule = site.node("rule", f"rule:{key}{within}:{number}", shown, block.text, at, rule_number=number, display_number=shown, part_title=title, effective_dates=DATE.findall(e.text), html_id=anchor)
        elif heading and anchor:
            h = site.node("chapter", f"chapter:{key}:heading:{anchor}", heading, url=at, part_title=title, html_id=anchor)
            site.edge(part, h, "contains", "site_structure")
            continue
        elif number and chapter != part and anchor and len(block.text) > 20:
            shown = chapter_title
            rule = site.node("rule", f"rule:{key}:unnumbered:{anchor}", shown, block.text, at, rule_number="", display_number=shown, part_title=title, effective_dates=DATE.findall(e.text), html_id=anchor, unnumbered_row=True)
        else:
            continue
        site.edge(chapter, rule, "contains", "site_structure")
        site.links(rule, block)
        site.inline_definitions(rule, shown, block, key, title)


def _document_type(url: str) -> str:
    return "supervisory_statement" if "/supervisory-statements/" in url else "statement_of_policy" if "/statements-of-policy/" in url else "guidance_document"


def read_guidance(site: Site, page: Element) -> None:
    """A guidance document: its sections and paragraphs with links."""
    title, key = _title(site, page), f"guidance_document:{site.path()}"
    doc = site.node("guidance_document", key, title, document_type=_document_type(site.url), rulebook_date=_date(page))
    parent, parent_key = doc, key
    for kind, number, heading, body, anchor, _ in _rows(page.first("rulebook-content") or page.first("page-content") or page):
        at = f"{site.url}#{anchor}"
        if kind == "chapter":
            heading = heading or f"Section {number}"
            parent_key = f"guidance_section:{key}:{number or heading.lower() or anchor}"
            parent = site.node("guidance_section", parent_key, heading, url=at, section_number=number, document_title=title, html_id=anchor)
            site.edge(doc, parent, "contains", "site_structure")
            continue
        text = body.text if body else ""
        if text and number and PARAGRAPH_NUMBER.match(number):
            p = site.node("guidance_paragraph", f"guidance_paragraph:{parent_key}:{number}", f"{title} {number}", text, at, paragraph_number=number, document_title=title, html_id=anchor)
        elif anchor and len(text) > 20:
            p = site.node("guidance_paragraph", f"guidance_paragraph:{key}:unnumbered:{anchor}", f"{title} – unnumbered paragraph", text, at, paragraph_number="", document_title=title, html_id=anchor, unnumbered_row=True)
        else:
            continue
        site.edge(parent, p, "contains", "site_structure")
        site.links(p, body)


def read_index(site: Site, page: Element) -> None:
    """The list of Parts, with the categories of firms named in front of their titles."""
    root = site.node("rulebook", "rulebook:pra-rules", "PRA Rules")
    for a in page.walk():
        path = a.attrs.get("href", "") if a.tag == "a" else ""
        if not path.startswith("/pra-rules/") or path.split("?")[0].removeprefix("/pra-rules").strip("/") in LISTINGS or not a.text:
            continue
        *before, title = a.lines()
        full = urljoin(site.url, path)
        named = [c for c in CATEGORIES if any(c.lower() in x.lower() for x in before)]
        part = site.node("part", f"part:{site.path(full)}", title, url=full, firm_categories=named)
        site.edge(root, part, "contains", "site_structure")


def read_guidance_index(site: Site, page: Element) -> None:
    """The list of guidance documents."""
    root = site.node("guidance_index", "guidance", "PRA Guidance")
    for box in (e for e in page.walk() if "search-results" in e.classes):
        for a in box.walk():
            href = a.attrs.get("href", "") if a.tag == "a" else ""
            if re.match(r"/guidance/[^?#]+", href):
                head, full = a.first(tags=("h3",)), urljoin(site.url, href)
                doc = site.node("guidance_document", f"guidance_document:{site.path(full)}", (head or a).text, url=full, document_type=_document_type(href), firm_categories=[t.text for t in a.walk() if "release-tag" in t.classes])
                site.edge(root, doc, "contains", "site_structure")


def _terms(page: Element) -> Iterator[tuple[str, str, Element, str, str]]:
    """(term, definition, body, anchor, whole text): row blocks, or else third-level headings with what follows them."""
    content = page.first("page-content") or page
    blocks = [e for e in content.walk() if "row-block" in e.classes]
    for e in blocks:
        term, body = e.first("rule-number"), e.first("div-row__col-2")
        if term and body and term.text and body.text and term.text.lower() != "definition":
            yield term.text, body.text, body, "", e.text
    for parent in () if blocks else (content, *content.walk()):
        below = [x for x in parent.inside if isinstance(x, Element)]
        for k, h in enumerate(below):
            if h.tag != "h3" or not h.text or h.text.lower() in ("export page as", "follow bank of england", "browse website"):
                continue
            said = []
            for x in below[k + 1 :]:
                if x.tag == "h3" or "Legal Instruments that change this definition" in x.text:
                    break
                if x.text and not x.text.startswith(("PDF ", "Print ")):
                    said.append(x.text)
            if len(" ".join(said)) >= 8:
                yield h.text, " ".join(said), parent, parent.attrs.get("id", h.attrs.get("id", "")), " ".join(said)


def read_glossary(site: Site, page: Element, crr: bool = False) -> None:
    """A glossary or the list of terms of the regulation: defined terms with their definitions and links."""
    root = site.node("crr_terms_list", "crr_terms_list", "CRR Terms List") if crr else site.node("glossary", "glossary", "PRA Rulebook Glossary")
    source, method = ("crr_terms_list", "crr_terms_source") if crr else ("glossary", "glossary_source")
    for term, definition, body, anchor, whole in _terms(page):
        n = site.node("defined_term", f"defined_term:{'crr' if crr else 'glossary'}:{term.lower()}", term, definition, f"{site.url}#{anchor}" if anchor else site.url, source=source, dates=DATE.findall(whole))
        site.edge(root, n, "defines", method)
        site.links(n, body)


def read_instruments(site: Site, page: Element) -> None:
    """The list of legal instruments with what they amend."""
    root = site.node("legal_instruments_index", "legal_instruments", "PRA Legal Instruments")
    for card in (e for e in page.walk() if "card-block" in e.classes):
        link, name = card.first("card-block__link", tags=("a",)), card.first("card-block__title")
        if not link or not name or not link.attrs.get("href"):
            continue
        full, date = urljoin(site.url, link.attrs["href"]), card.first("card-block__date")
        inst = site.node("legal_instrument", f"legal_instrument:{full}", name.text, url=full, published=date.text if date else "", effective=[e.text for e in card.walk() if "card-block__sub-title" in e.classes and "Effective" in e.text])
        site.edge(root, inst, "contains", "site_structure")
        bottom = card.first("card-block__bottom")
        for a in bottom.walk() if bottom else ():
            href = a.attrs.get("href", "") if a.tag == "a" else ""
            if not href:
                continue
            to = urljoin(site.url, href)
            target = f"url:{site.path(to)}" if href.startswith("/pra-rules/") else "glossary" if href.startswith("/glossary") else "crr_terms_list" if href.startswith("/crr-terms-list") else f"external:{to}"
            kind, conf = ("references", 0.9) if target.startswith("external:") else ("amends", 1.0)
            site.edge(inst, node_key(target), kind, "legal_instrument_listing", href, confidence=conf, evidence=a.text, href=to, target_key=target)


READERS = {"rulebook_index": read_index, "part": read_part, "guidance_index": read_guidance_index, "guidance": read_guidance, "glossary": read_glossary, "crr_terms": lambda site, page: read_glossary(site, page, True), "instrument": read_instruments}
_COLUMNS = ("record", "id", "kind", "stable_key", "title", "text", "from_node_id", "to_node_id", "source_method", "confidence", "evidence_text", "url", "metadata_json")


def read_page(kind: str, url: str, html: str) -> list[dict]:
    """Records of nodes and edges of one page; none for a kind that isn't known."""
    reader = READERS.get(kind)
    if reader is None or not html:
        return []
    site = Site(url)
    reader(site, tree(html))
    return [*site.records.values()]


def read_site(pages: DataFrame, kind: str = "source_type", url: str = "url", html: str = "raw_html") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the pages; of nodes and edges that several pages give, that of the first URL stays.

    Pages without a kind, URL or text give nothing. Broken markup is read as far as it goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, of = [], []
            for k, u, h in zip(*(c.to_pylist() for c in b.columns)):
                found = read_page(k, u, h) if k and u and h else []
                out += found
                of += [u] * len(found)
            if out:
                cols = [pa.array([r.get(c) for r in out], pa.float64() if c == "confidence" else pa.string()) for c in _COLUMNS]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(of, pa.string())], [*_COLUMNS, "page"])

    schema = ", ".join(f"{c} {'double' if c == 'confidence' else 'string'}" for c in _COLUMNS) + ", page string"
    records = cut(pages.select(kind, url, html).mapInArrow(run, schema))
    one = pick(records, ["record", "id"], [F.col("page"), F.xxhash64(*_COLUMNS)])
    nodes = one.where("record = 'node'").select("id", F.col("kind").alias("node_type"), "stable_key", "title", "text", "url", "metadata_json")
    edges = one.where("record = 'edge'").select("id", "from_node_id", "to_node_id", F.col("kind").alias("edge_type"), "source_method", "confidence", "evidence_text", F.col("url").alias("source_url"), "metadata_json")
    return nodes, edges
