"""Markup residue: documents in HTML, Markdown, wiki text or LaTeX to clean text that keeps its structure.

Each notation is read by its own pass, which records that it was found and turns its signs into blocks (headings,
paragraphs, list items, code, tables, formulas). Then two passes of block rules part content from boilerplate: the
first decides by link density, length and the density of stop words, the second lets short or middling blocks
inherit from their nearest decided neighbours. Stop words are known for the languages of STOP_WORDS; on a page of
another language their density says nothing and isn't used.
"""

from __future__ import annotations

import html
import html.entities
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrowmap import add_columns

HTML, MARKDOWN, WIKI, LATEX = "html", "markdown", "wiki", "latex"

#: Names of HTML elements, of LaTeX commands, and frequent function words.
TAGS = "a abbr address article aside b base blockquote body br button caption center cite code col colgroup dd del dfn div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main map mark menu meta nav noscript object ol option p param pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video wbr".split()
BLOCK_TAGS = set("address article aside blockquote body caption center dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav noscript ol option p pre script section select style table tbody td tfoot th thead title tr ul".split())
COMMANDS = "begin end section subsection subsubsection chapter part paragraph item emph textbf textit texttt textsc underline cite citep citet ref eqref pageref label footnote url href documentclass usepackage title author date maketitle caption includegraphics input include hline cline toprule midrule bottomrule frac sum prod int sqrt leq geq neq times cdot alpha beta gamma delta lambda sigma left right quad qquad S ldots dots newline newpage noindent vspace hspace textsuperscript textsubscript mathbf mathrm text multicolumn centering".split()
STOP_WORDS = set(
    " ".join(
        [
            "a about after all also an and any are as at be been before but by can could did do does each every for from had has have he her his how i if in into is it its may more most must no not of on only or other our out over own shall she should so some such than that the their them then there these they this those to under until up upon was we were what when where which who will with within would you your",
            "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer eines er es für hat im in ist kann mit muss nach nicht noch nur oder sich sie sind so über um und unter vom von vor werden wenn wie wird zu zum zur",
            "au aux avec ce ces cette dans de des doit du elle en est et il la le les leur mais ne nous on ou par pas plus pour que qui sa se ses si son sont sur un une vous",
            "al como con cuando de debe del el en entre es esta este la las lo los más no o para pero por que se si sin sobre su sus un una y ya",
            "che di e gli i il nel non per sono una uno deve della delle",
            "een en het van voor niet dat de te zijn met op",
            "é do da dos das em um uma não ao os na no que para com",
            "को का की के में है हैं और से पर यह भी नहीं ने कि एक या तो",
            "في من على إلى أن لا ما هذا هذه التي الذي أو عن مع كل يجب قد",
        ]
    ).split()
)
#: Frequent grammatical characters of scripts written without spaces, where characters stand for words (fixed values).
STOP_CHARACTERS = set("的了是在不和有也与或及其应而为于以の に は を が と で も た し て れ る い ที่ และ ใน ของ ให้ ได้ ไม่ การ".replace(" ", ""))

#: Thresholds of the block rules.
LONG, SHORT = 200, 70
LINKS, STOP_LOW, STOP_HIGH = 0.5, 0.15, 0.3
#: Words of a block whose density of stop words shows that the page's language is one whose stop words are known.
TELLING = 10

_TAG = re.compile(r"<(/?)(" + "|".join(sorted(TAGS, key=len, reverse=True)) + r")((?:\s[^<>]*)?)/?>", re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>|<\?xml[^>]*>", re.I | re.S)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_ESCAPED = re.compile(r"&(?:amp;)*lt;(?:/?(?:" + "|".join(sorted(TAGS, key=len, reverse=True)) + r")\b|!--|!DOCTYPE)", re.I)
_COMMAND = re.compile(r"\\(" + "|".join(sorted(COMMANDS, key=len, reverse=True)) + r")\*?(?![A-Za-z])")
_ANY_COMMAND = re.compile(r"(?<![\w:\\])\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])*\{")
_MATH = re.compile(r"\$\$(.+?)\$\$|\$(?=[^$\n]+\$)([^$\n]*(?:\\[A-Za-z]+|[\^_]\{?\w)[^$\n]*)\$|\\\[(.+?)\\\]|\\\((.+?)\\\)", re.S)
_TEX_QUOTE = re.compile(r"``((?:[^`'\n]|'(?!'))+)''")
#: Commands whose argument is no text of the document (fixed values).
_SILENT = set("label cite citep citet ref eqref pageref footnote vspace hspace includegraphics input include".split())
#: Commands whose argument is a heading (fixed values).
_HEADINGS = set("chapter part section subsection subsubsection paragraph title".split())
_BRACES = re.compile(r"~?\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])*\{|\\.|[{}]", re.S)
_OPEN_TAG = re.compile(r"<([A-Za-z][\w.:-]*)(?:\s[^<>]*)?>")
_CLOSE_TAG = re.compile(r"</([A-Za-z][\w.:-]*)\s*>")
#: What shows that the text inside an HTML block goes on in another notation: a blank line, a sign at a line's start, a command.
_LINED = re.compile(r"\n[^\S\n]*\n|^[^\S\n]*(?:#{1,6}\s|[-*+>]\s|={1,6}[^=\n]+={1,6}[^\S\n]*$|\{\||```|~~~|\|)|\\[A-Za-z]+", re.M)


def _unescape(text: str) -> str:
    """Character entities replaced until none is left, as they may be escaped themselves."""
    while any(_entity(m[0]) for m in _ENTITY.finditer(text)):
        done = html.unescape(text)
        if done == text:
            break
        text = done
    return text


def _unbraced(text: str, keep_heading) -> str:
    """LaTeX commands with a braced argument, nested to any depth: silent ones go, headings are handed over, others leave their text."""
    out: list[str] = []
    open_: list[tuple[str, int, str]] = []  # what the brace belongs to, where its text starts in `out`, as it was written
    at = 0
    for m in _BRACES.finditer(text):
        out.append(text[at : m.start()])
        at = m.end()
        name = m[1]
        if name is not None and name not in ("begin", "end", "frac", "sqrt", "multicolumn"):
            open_.append((name, len(out), m[0]))
            out.append("")
        elif m[0].endswith("{") and m[0][0] != "\\" or name is not None:
            open_.append(("", len(out), m[0]))
            out.append(m[0])
        elif m[0] == "}" and open_:
            kind, start, _ = open_.pop()
            if kind in _SILENT:
                del out[start:]
            elif kind in _HEADINGS:
                out[start:] = [keep_heading("".join(out[start:]))]
            elif not kind:
                out.append("}")
        else:
            out.append(m[0])
    for kind, start, written in open_:
        if kind:
            out[start] = written  # never closed
    return "".join(out) + text[at:]


@dataclass
class Block:
    kind: str  # heading, text, item, code, table, formula, drop
    text: str
    links: int = 0  # characters inside links


def _entity(name: str) -> bool:
    return name[1] == "#" or name[1:] in html.entities.html5


class Document:
    """Blocks and notations of one document."""

    def __init__(self, raw: str) -> None:
        self.found: set[str] = set()
        self.kept: list[Block] = []
        text = re.sub("[\ue000\ue001]", "", raw).replace("\r\n", "\n").replace("\r", "\n")
        while _ESCAPED.search(text) and not _TAG.search(text):
            self.found.add(HTML)
            text = html.unescape(text)
        self.blocks = self._lines(self._latex(self._html(text)))

    # Finished blocks wait in `kept` behind a private sign, so that later passes leave them alone.
    def _keep(self, block: Block) -> str:
        self.kept.append(block)
        return f"\n\ue000{len(self.kept) - 1}\ue001\n"

    def _html(self, text: str) -> str:
        if _COMMENT.search(text) or _TAG.search(text):
            self.found.add(HTML)
        if any(_entity(m[0]) for m in _ENTITY.finditer(text)):
            self.found.add(HTML)
        # Elements of any other name: those that are opened and closed.
        other = ({m[1].lower() for m in _CLOSE_TAG.finditer(text)} & {m[1].lower() for m in _OPEN_TAG.finditer(text)}) - set(TAGS)
        if other:
            self.found.add(HTML)
            text = re.sub(r"</?([A-Za-z][\w.:-]*)(?:\s[^<>]*)?>", lambda m: "" if m[1].lower() in other else m[0], text)
        if HTML not in self.found:
            return text
        text = _COMMENT.sub("", text)
        text = re.sub(r"<(script|style|head|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", "\n", text, flags=re.I | re.S)
        text = re.sub(r"<pre\b[^>]*>(.*?)(?:</pre\s*>|\Z)", lambda m: self._keep(Block("code", _unescape(_TAG.sub("", m[1])).strip("\n"))), text, flags=re.I | re.S)
        text = re.sub(r"<nav\b[^>]*>(.*?)(?:</nav\s*>|\Z)", lambda m: self._keep(Block("text", self._inline_html(m[1]), 10**6)), text, flags=re.I | re.S)
        text = re.sub(r"<table\b[^>]*>(.*?)(?:</table\s*>|\Z)", self._html_table, text, flags=re.I | re.S)
        out: list[str] = []
        at, stack, tag_block = 0, [], ""
        part: list[str] = []
        links, link_from = 0, -1

        def flush(kind: str) -> None:
            nonlocal part, links
            body = _unescape("".join(part))
            if body.strip():
                if kind == "free":
                    out.append("\n" + body + "\n")
                elif _LINED.search(body.strip()):
                    # A block that was never closed, or text in another notation: left to the passes that follow.
                    out.append("\n\n" + re.sub(r"(?m)^[^\S\n]+", "", body) + "\n\n")
                else:
                    out.append(self._keep(Block(kind, re.sub(r"\s+", " ", body).strip(), links)))
            part, links = [], 0

        kind = "free"
        for m in _TAG.finditer(text):
            chunk = text[at : m.start()]
            at = m.end()
            if "\ue000" in chunk or kind == "free":
                if kind != "free" and "\ue000" in chunk:
                    head, _, rest = chunk.partition("\n\ue000")
                    part.append(head)
                    flush(kind)
                    kind = "free"
                    part.append("\n\ue000" + rest)
                else:
                    part.append(chunk)
            else:
                part.append(chunk)
            closing, name = m[1] == "/", m[2].lower()
            if name in ("sub", "sup"):
                if not closing:
                    part.append("_" if name == "sub" else "^")
            elif name == "a":
                if not closing:
                    link_from = sum(map(len, part))
                elif link_from >= 0:
                    links += max(0, sum(map(len, part)) - link_from)
                    link_from = -1
            elif name == "br":
                part.append(" " if kind != "free" else "\n\n")
            elif name in ("code", "tt", "kbd", "samp"):
                part.append("")
            elif name in BLOCK_TAGS:
                classes = m[3].lower()
                flush(kind)
                if name in ("ul", "ol"):
                    if closing:
                        if stack:
                            stack.pop()
                    else:
                        stack.append([name, 0])
                    kind = "free"
                elif name == "li":
                    if not closing:
                        if stack:
                            stack[-1][1] += 1
                        part.append(f"{stack[-1][1]}. " if stack and stack[-1][0] == "ol" else "- ")
                        kind = "item"
                    else:
                        kind = "free"
                elif re.fullmatch(r"h[1-6]", name) or "heading" in classes:
                    kind = "free" if closing else "heading"
                    tag_block = name if not closing else ""
                elif closing:
                    kind = "heading" if tag_block and tag_block != name and kind == "heading" else "free"
                    if name == tag_block:
                        tag_block = ""
                else:
                    kind = "text" if name in ("p", "dd", "dt", "blockquote", "td", "figcaption") or name == "div" else "free"
        part.append(text[at:])
        flush(kind)
        return "".join(out)

    def _inline_html(self, text: str) -> str:
        return re.sub(r"\s+", " ", _unescape(_TAG.sub(" ", text))).strip()

    def _html_table(self, m: re.Match) -> str:
        rows = [[self._inline_html(c) for c in re.split(r"<t[dh]\b[^>]*>", r, flags=re.I)[1:]] for r in re.split(r"<tr\b[^>]*>", m[1], flags=re.I)]
        return self._keep(Block("table", "\n".join(" | ".join(r) for r in rows if r)))

    def _latex(self, text: str) -> str:
        signs = _COMMAND.search(text) or _ANY_COMMAND.search(text) or _MATH.search(text) or _TEX_QUOTE.search(text)
        if not signs:
            return text
        self.found.add(LATEX)
        text = re.sub(r"\\begin\{(verbatim|lstlisting)\}\n?(.*?)(?:\\end\{\1\}|\Z)", lambda m: self._keep(Block("code", m[2].strip("\n"))), text, flags=re.S)
        text = re.sub(r"\\begin\{tabular\}\{[^}]*\}(.*?)(?:\\end\{tabular\}|\Z)", self._tex_table, text, flags=re.S)
        text = re.sub(r"\\\[(.+?)\\\]|\$\$(.+?)\$\$", lambda m: self._keep(Block("formula", (m[1] or m[2]).strip())), text, flags=re.S)
        text = re.sub(r"\\(?:documentclass|usepackage)(?:\[[^\]]*\])?\{[^}]*\}|\\(?:begin|end)\{document\}|\\maketitle", "", text)
        text = _unbraced(text, lambda title: self._keep(Block("heading", title.strip())))
        counters: list[int] = []

        def listing(m: re.Match) -> str:
            if m[1]:
                counters.append(0 if "enumerate" in m[1] else -1)
                return "\n"
            if m[2]:
                if counters:
                    counters.pop()
                return "\n\n"
            if counters and counters[-1] >= 0:
                counters[-1] += 1
                return f"\n{counters[-1]}. "
            return "\n- "

        text = re.sub(r"\\begin\{(itemize|enumerate|description)\}|\\end\{(itemize|enumerate|description)\}|\\item\b\s*", listing, text)
        text = re.sub(r"\\(?:hline|toprule|midrule|bottomrule|centering|noindent|newpage|S)\b", "", text)
        text = re.sub(r"\\(?:begin|end)\{[^}]*\}", "\n", text)
        text = re.sub(r"\\\\(?:\[\w+\])?", "\n" if signs else "", text)
        return _TEX_QUOTE.sub(r"“\1”", text)

    def _tex_table(self, m: re.Match) -> str:
        rows = [re.sub(r"\\(?:hline|toprule|midrule|bottomrule)\b", "", r).strip() for r in re.split(r"\\\\(?:\[\w+\])?", m[1])]
        return self._keep(Block("table", "\n".join(" | ".join(c.strip() for c in re.split(r"(?<!\\)&", r)) for r in rows if r)))

    def _see(self, notation: str, pattern: str, text: str, by: str = r"\1") -> str:
        got, n = re.subn(pattern, by, text)
        if n:
            self.found.add(notation)
        return got

    def _inline(self, text: str) -> tuple[str, int]:
        """Inline signs of wiki text and Markdown; the characters that stood in links."""
        links = 0

        def link(m: re.Match) -> str:
            nonlocal links
            links += len(m[1])
            return m[1]

        if "`" in text:
            text = self._see(MARKDOWN, r"`([^`\n]+)`(?!`)", text)
        if "'''" in text or "''" in text:
            text = self._see(WIKI, r"'''''(?=\S)(.+?)'''''", text)
            text = self._see(WIKI, r"'''(?=\S)(.+?)'''", text)
            text = self._see(WIKI, r"(?<!')''(?=[^\s'])(.+?)''(?!')", text)
        if "[[" in text:
            text = self._see(WIKI, r"\[\[(?:Category|File|Image|Kategorie|Datei)\s*:[^\[\]]*\]\]", text, "")
            if re.search(r"\[\[[^\[\]\n]+\]\]", text):
                self.found.add(WIKI)
                text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]", link, text)
        if "{{" in text:
            text = self._see(WIKI, r"\{\{[^{}\n]+\}\}", text, "")
        if "](" in text:
            if re.search(r"!?\[[^\[\]\n]*\]\([^()\s]+(?:\s\"[^\"]*\")?\)", text):
                self.found.add(MARKDOWN)
                text = re.sub(r"!\[([^\[\]\n]*)\]\([^()\s]+(?:\s\"[^\"]*\")?\)", "", text)
                text = re.sub(r"\[([^\[\]\n]+)\]\([^()\s]+(?:\s\"[^\"]*\")?\)", link, text)
        if "[^" in text:
            text = self._see(MARKDOWN, r"\[\^\w+\](?::.*)?", text, "")
        if "[http" in text:
            if re.search(r"\[https?://\S+\s+[^\[\]\n]+\]", text):
                self.found.add(WIKI)
                text = re.sub(r"\[https?://\S+\s+([^\[\]\n]+)\]", link, text)
        if "**" in text:
            text = self._see(MARKDOWN, r"\*\*(?=[^\s*])(.+?)(?<=[^\s])\*\*", text)
        if "__" in text:
            text = self._see(MARKDOWN, r"(?<!\w)__(?=[^\s_])(.+?)(?<=[^\s_])__(?!\w)", text)
        if "~~" in text:
            text = self._see(MARKDOWN, r"~~(?=\S)(.+?)(?<=\S)~~", text)
        return re.sub(r"[^\S\n]+", " ", text).strip(), links

    def _lines(self, text: str) -> list[Block]:
        out: list[Block] = []
        para: list[str] = []

        def flush() -> None:
            if para:
                body, links = self._inline("\n".join(para))
                if body:
                    out.append(Block("text", body, links))
                para.clear()

        def add(kind: str, raw: str, prefix: str = "") -> None:
            flush()
            body, links = self._inline(raw)
            if body:
                out.append(Block(kind, prefix + body, links))

        lines = text.split("\n")
        i = 0
        while i < len(lines):
            line = lines[i]
            i += 1
            s = line.strip()
            if "\ue000" in line:
                k = re.search("\ue000(\\d+)\ue001", line)
                flush()
                if k:
                    b = self.kept[int(k[1])]
                    if b.kind in ("text", "heading", "item"):
                        body, links = self._inline(b.text)
                        out.append(Block(b.kind, body, b.links + links))
                    else:
                        out.append(b)
                continue
            if not s:
                flush()
            elif line[0] == " " and WIKI in self.found and not para:
                code = [line]
                while i < len(lines) and lines[i].startswith(" ") and lines[i].strip():
                    code.append(lines[i])
                    i += 1
                out.append(Block("code", "\n".join(x[1:] for x in code)))
            elif m := re.match(r"(```|~~~)\w*$", s):
                self.found.add(MARKDOWN)
                flush()
                code = []
                while i < len(lines) and not lines[i].strip().startswith(m[1]):
                    code.append(lines[i])
                    i += 1
                i += 1
                out.append(Block("code", "\n".join(code)))
            elif m := re.match(r"#{1,6}\s+(\S.*?)\s*#*$", s):
                if s.startswith("#") and not re.match(r"#\s+\d+\s", s):
                    self.found.add(MARKDOWN)
                    add("heading", m[1])
                else:
                    para.append(s)
            elif re.fullmatch(r"={4,}|-{4,}", s) and len(para) == 1 and i >= 2 and lines[i - 2].strip():
                self.found.add(MARKDOWN)
                title = para.pop()
                add("heading", title)
            elif m := re.match(r"(={1,6})\s*([^=\s].*?)\s*\1$", s):
                self.found.add(WIKI)
                add("heading", m[2])
            elif s.startswith("{|"):
                self.found.add(WIKI)
                flush()
                rows, row = [], []
                while i < len(lines) and not lines[i].strip().startswith("|}"):
                    c = lines[i].strip()
                    i += 1
                    if c.startswith("|-"):
                        rows.append(row)
                        row = []
                    elif c.startswith(("|", "!")):
                        row += [self._inline(x)[0] for x in re.split(r"\|\||!!", c[1:])]
                i += 1
                rows.append(row)
                out.append(Block("table", "\n".join(" | ".join(r) for r in rows if r)))
            elif i < len(lines) and "|" in s and re.fullmatch(r"\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?", lines[i].strip()):
                self.found.add(MARKDOWN)
                flush()
                rows = [s]
                i += 1
                while i < len(lines) and "|" in lines[i] and lines[i].strip():
                    rows.append(lines[i].strip())
                    i += 1
                out.append(Block("table", "\n".join(" | ".join(self._inline(c)[0] for c in r.strip("|").split("|")) for r in rows)))
            elif m := re.match(r">\s+(.*)", s):
                self.found.add(MARKDOWN)
                para.append(m[1])
            elif m := re.match(r"([-*+])\s+(\S.*)", s):
                add("item", m[2], "- ")
            elif re.match(r"\d{1,3}\.\s+\S|\([a-z0-9]{1,3}\)\s", s) and not para:
                add("item", s)
            elif m := re.match(r"[:;]\s+(\S.*)", s):
                add("text", m[1])
            else:
                para.append(s)
        flush()
        return out

    def content(self) -> list[Block]:
        """The blocks that are content, by the two passes of block rules."""
        density = []
        for b in self.blocks:
            words = [w for x in re.findall(r"[^\W\d_]+", b.text.lower()) for w in (x if ord(x[0]) >= 0x0E00 else [x])]
            n = sum(w in STOP_WORDS or w in STOP_CHARACTERS for w in words)
            density.append((n / len(words) if words else 0.0, len(words)))
        known = any(stop >= STOP_HIGH and words >= TELLING for stop, words in density)
        # First pass: every block by itself. Tables written in plain text have few stop words but many figures.
        labels = []
        for b, (stop, words) in zip(self.blocks, density):
            n = len(b.text)
            if b.kind == "drop" or b.links > LINKS * n:
                labels.append("bad")
            elif b.kind in ("code", "table", "formula", "heading"):
                labels.append("kept")
            elif b.kind == "item" or n < SHORT:
                labels.append("short")
            elif not known:
                labels.append("near")
            elif stop >= STOP_HIGH:
                labels.append("good" if n > LONG else "near")
            elif stop >= STOP_LOW:
                labels.append("near")
            else:
                figures = sum(c.isdigit() for c in b.text)
                sentences = re.search(r"[.;!?。！？।؟](?:\s|\Z)", b.text)
                labels.append("bad" if words >= 8 and figures < 0.03 * n and not sentences else "short")
        # Second pass: short and middling blocks go with the nearest decided ones around them.
        before, after, last = [("", 0)] * len(labels), [("", 0)] * len(labels), ("", 0)
        for i, x in enumerate(labels):
            before[i] = last
            if x in ("good", "bad"):
                last = (x, i)
        last = ("", 0)
        for i in range(len(labels) - 1, -1, -1):
            after[i] = last
            if labels[i] in ("good", "bad"):
                last = (labels[i], i)
        out = []
        for i, (b, x) in enumerate(zip(self.blocks, labels)):
            (p, pi), (q, qi) = before[i], after[i]
            if x == "short" and p and q and p != q and not density[i][0] and not re.search(r"\d|[.;:!?]\Z", b.text):
                x = p if i - pi < qi - i else q if i - pi > qi - i else "good"  # nothing in it speaks for content
            if x in ("kept", "good") or x in ("near", "short") and not p == q == "bad":
                out.append(b)
        return out

    def text(self) -> str:
        parts: list[str] = []
        previous = ""
        for b in self.content():
            body = "\n".join("    " + x for x in b.text.split("\n")) if b.kind == "code" else b.text
            parts.append(("\n" if b.kind == "item" == previous else "\n\n") + body)
            previous = b.kind
        done = "".join(parts).strip("\n")
        while (k := re.search("\n?\ue000(\\d+)\ue001\n?", done)) is not None:  # a block inside another
            done = done[: k.start()] + "\n" + self.kept[int(k[1])].text + "\n" + done[k.end() :]
        return done


def clean_markup(df: DataFrame, raw: str = "raw_html", out: str = "clean_text", markups: str = "markups") -> DataFrame:
    """Add the clean text and the sorted list of notations found (html, latex, markdown, wiki).

    A text without markup keeps its words; null stays null with an empty list, an empty text stays empty. Headings,
    list items (`- `, `1. `), tables (cells parted by ` | `), code (indented by four spaces) and formulas stay as
    blocks of their own. Columns with the names of the new ones are replaced, others pass through; one output row
    per input row.
    """

    def make():
        def f(texts: pa.Array) -> list[pa.Array]:
            a, b = [], []
            for t in texts.to_pylist():
                d = Document(t) if t else None
                a.append(d.text() if d else t)
                b.append(sorted(d.found) if d else [])
            return [pa.array(a, pa.string()), pa.array(b, pa.list_(pa.string()))]

        return f

    return add_columns(df, [raw], [T.StructField(out, T.StringType()), T.StructField(markups, T.ArrayType(T.StringType()))], make)


def found_markups(cleaned: DataFrame, key: str, markups: str = "markups") -> DataFrame:
    """One row per document and notation."""
    return cleaned.select(F.col(key), F.explode(markups).alias("markup"))
