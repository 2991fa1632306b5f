"""Parsers of single files of marked-up text: XML, e-mail, RTF, plain text, CSV, and footnotes of HTML pages.

Each takes bytes and returns (metadata, elements): a dict of strings, and Element tuples in document order.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
import xml.sax
from html.parser import HTMLParser
from typing import NamedTuple


class Element(NamedTuple):
    kind: str
    text: str
    depth: int = 0
    section: str | None = None
    page: int | None = None
    attrs: dict = {}


Parsed = tuple[dict, list[Element]]


def table(rows: list[list[str]]) -> str:
    """A Markdown table, the first row as its head, short rows filled up."""
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]) if rows else ""


def parse_text(data: bytes) -> Parsed:
    out = []
    for block in re.split(r"\n\s*\n", data.decode(errors="replace")):
        t = block.strip()
        size = len(t.encode())
        if t:
            capital = size <= 100 and t == t.upper() and re.search("[A-Z]", t)
            out.append(Element("title", t) if capital else Element("heading", t, 1) if size <= 80 and t.endswith(":") else Element("paragraph", t))
    first = next((e.text for e in out if e.kind in ("title", "heading")), None)
    return ({"title": first} if first else {}), out


ROWS = 100


def parse_csv(data: bytes) -> Parsed:
    """A table element for each ROWS rows, each with the header; cells beyond the header's are left out."""
    rows = [r for r in csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"))) if r]
    if not rows:
        return {"row_count": "0", "column_count": "0"}, []
    head, body = rows[0], [r[: len(rows[0])] for r in rows[1:]]
    out = [Element("table", table([head, *body[k : k + ROWS]])) for k in range(0, len(body), ROWS)] or [Element("table", table([head]))]
    return {"row_count": str(len(body)), "column_count": str(len(head))}, out


# XML tags by what they hold.
_XML_KINDS = {"title": ("title", 0), "h1": ("title", 0), "heading": ("heading", 1), "p": ("paragraph", 0), "para": ("paragraph", 0), "code": ("code", 0), "pre": ("code", 0)} | {f"h{n}": ("heading", n - 1) for n in range(2, 7)}
_LISTS, _ITEMS, _ROWS, _CELLS, _IMAGES = {"ul", "ol", "list"}, {"li", "item"}, {"tr", "row"}, {"td", "th", "cell"}, {"img", "image"}


class _Xml(xml.sax.ContentHandler):
    """Text goes to the innermost known tag; tables and lists are gathered until they close."""

    def __init__(self):
        super().__init__()
        self.out: list[Element] = []
        self.open: list[str] = []
        self.text, self.root = [], None
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None
        self.items: list[str] | None = None

    def flush(self):
        t = "".join(self.text).strip()
        self.text = []
        if t:
            kind, depth = next((_XML_KINDS[x] for x in reversed(self.open) if x in _XML_KINDS), ("paragraph", 0))
            self.out.append(Element(kind, t, depth))

    def startElement(self, name, attrs):
        self.root = self.root or name
        if name == "table":
            self.flush()
            self.rows = []
        elif name in _ROWS and self.rows is not None:
            self.rows.append([])
        elif name in _CELLS and self.rows is not None:
            self.cell = []
        elif name in _LISTS:
            self.flush()
            self.items = []
        elif name in _ITEMS and self.items is not None:
            self.text = []
        elif name in _IMAGES:
            self.flush()
            where = attrs.get("src") or attrs.get("href") or ""
            self.out.append(Element("image", where, attrs={"alt": attrs["alt"]} if "alt" in attrs else {}))
        elif name in _XML_KINDS:
            self.flush()
        self.open.append(name)

    def endElement(self, name):
        if name == "table" and self.rows is not None:
            if rows := [r for r in self.rows if r]:
                self.out.append(Element("table", table(rows)))
            self.rows = None
        elif name in _CELLS and self.cell is not None:
            if self.rows:
                self.rows[-1].append("".join(self.cell).strip())
            self.cell = None
        elif name in _ITEMS and self.items is not None:
            if t := "".join(self.text).strip():
                self.items.append(t)
            self.text = []
        elif name in _LISTS and self.items is not None:
            self.out += [Element("list_item", t) for t in self.items]
            self.items = None
        elif name in _XML_KINDS:
            self.flush()
        self.open.pop()

    def characters(self, content):
        (self.text if self.cell is None else self.cell).append(content)

    def endDocument(self):
        self.flush()


def parse_xml(data: bytes) -> Parsed:
    handler = _Xml()
    reader = xml.sax.make_parser()
    reader.setFeature(xml.sax.handler.feature_external_ges, False)
    reader.setContentHandler(handler)
    reader.parse(io.BytesIO(data))
    return {"root_element": handler.root}, handler.out


def parse_email(data: bytes) -> Parsed:
    m = email.message_from_bytes(data, policy=email.policy.default)
    meta = {k: str(m[k]) for k in ("subject", "from", "to", "date") if m[k] is not None}
    if "subject" in meta:
        meta["title"] = meta["subject"]

    def said(part) -> str:
        try:
            return part.get_content() if part.get_content_maintype() == "text" else ""
        except (LookupError, KeyError):
            return (part.get_payload(decode=True) or b"").decode(errors="replace")

    parts = list(m.iter_parts()) if m.is_multipart() else [m]
    ranked = [p for kind in ("text/plain", "text/html") for p in parts if p.get_content_type() == kind]
    body = said(ranked[0]) if ranked else next((t for p in parts if (t := said(p)).strip()), "")
    body = body.replace("\r\n", "\n")
    blocks = [b.strip() for b in body.split("\n\n") if b.strip()] or [x.strip() for x in body.splitlines() if x.strip()]
    return meta, [Element("paragraph", b) for b in blocks]


_RTF = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\(.)|([{}])|([^\\{}\r\n]+)|[\r\n]+", re.IGNORECASE | re.DOTALL)
_HIDDEN = {"fonttbl", "colortbl", "stylesheet", "filetbl", "info", "pict", "generator"}


def parse_rtf(data: bytes) -> Parsed:
    """Paragraphs between `\\par` words; groups of fonts, colours, styles and files are skipped."""
    paras, now, depth, hidden, skip = [], [], 0, None, 0
    for m in _RTF.finditer(data.decode(errors="replace")):
        word, number, code, sign, brace, plain = m.groups()
        if brace == "{":
            depth += 1
        elif brace == "}":
            if hidden == depth:
                hidden = None
            depth -= 1
        elif hidden is not None:
            continue
        elif sign == "*" or (word or "").lower() in _HIDDEN:
            hidden = depth
        elif word in ("par", "line"):
            paras.append("".join(now))
            now = []
        elif word == "tab":
            now.append("\t")
        elif word == "u" and number:
            now.append(chr(int(number) % 65536))
            skip = 1
        elif code:
            if skip:
                skip = 0
            else:
                now.append(bytes([int(code, 16)]).decode("cp1252", "replace"))
        elif sign and sign in "\\{}":
            now.append(sign)
        elif plain:
            now.append(plain[skip:])
            skip = 0
    blocks = [t for p in [*paras, "".join(now)] if (t := p.strip())]
    titled = bool(blocks) and len(blocks[0].encode()) <= 100 and "\n" not in blocks[0]
    out = [Element("title" if titled and i == 0 else "paragraph", t) for i, t in enumerate(blocks)]
    return ({"title": blocks[0]} if titled else {}), out


class _Notes(HTMLParser):
    """Footnotes (`li` with an id in a notes container) and what paragraphs refer to by `sup > a`."""

    # Containers of notes as tag and class, or any tag with the role.
    HOLDERS = {("section", "footnotes"), ("div", "footnotes"), ("div", "endnotes"), ("ol", "footnotes")}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []  # tag, holds notes
        self.notes: dict[str, list[str]] = {}
        self.note: tuple[str, int] | None = None
        self.paras: list[tuple[list[str], list[str], int]] = []  # own text, references, depth
        self.refs: dict[str, list[str]] = {}

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        holds = any((tag, c) in self.HOLDERS for c in (a.get("class") or "").split()) or a.get("role") == "doc-endnotes"
        inside = any(h for _, h in self.open)
        if tag == "li" and inside and a.get("id") and a["id"] not in self.notes:
            self.notes[a["id"]] = []
            self.note = (a["id"], len(self.open))
        if tag == "a" and self.open and self.open[-1][0] == "sup" and (a.get("href") or "").startswith("#") and len(a["href"]) > 1 and self.paras:
            self.paras[-1][1].append(a["href"][1:])
        if tag not in ("br", "img", "hr", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track"):
            self.open.append((tag, holds))
            if tag == "p":
                self.paras.append(([], [], len(self.open)))

    def handle_endtag(self, tag):
        while self.open and any(t == tag for t, _ in self.open):
            last, _ = self.open.pop()
            if self.note and len(self.open) <= self.note[1]:
                self.note = None
            if last == "p" and self.paras:
                own, refs, _ = self.paras.pop()
                if refs:
                    self.refs.setdefault("".join(own).strip(), []).extend(refs)
            if last == tag:
                break

    def handle_data(self, data):
        if self.note:
            self.notes[self.note[0]].append(data)
        if self.paras and len(self.open) == self.paras[-1][2]:
            self.paras[-1][0].append(data)


def html_notes(html: str) -> tuple[list[Element], dict[str, str]]:
    """Footnote elements, each id once, and by a paragraph's own text the ids that it refers to, joined by commas."""
    p = _Notes()
    p.feed(html)
    p.close()
    found = [Element("footnote", t, attrs={"reference_id": i}) for i, parts in p.notes.items() if (t := "".join(parts).strip())]
    return found, {k: ",".join(v) for k, v in p.refs.items()}
