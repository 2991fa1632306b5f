"""Parsers of zipped office files: DOCX, PPTX, XLSX, EPUB. Standard library only; each takes bytes, returns (metadata, elements)."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

from .markup import Element, Parsed, table


def _name(node) -> str:
    return node.tag.rsplit("}", 1)[-1] if isinstance(node.tag, str) else ""


def _attr(node, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _all(node, name: str):
    return (x for x in node.iter() if _name(x) == name)


def _first_text(node, name: str) -> str | None:
    return next((t for x in _all(node, name) if (t := (x.text or "").strip())), None)


def _xml(files: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(files.read(name))


def _core(files: zipfile.ZipFile) -> dict:
    if "docProps/core.xml" not in files.namelist():
        return {}
    core = _xml(files, "docProps/core.xml")
    found = {"title": _first_text(core, "title"), "author": _first_text(core, "creator"), "created": _first_text(core, "created")}
    return {k: v for k, v in found.items() if v}


def style_kind(style: str | None) -> tuple[str, int]:
    """Kind and depth by a paragraph style: Title, HeadingN, lists, else a paragraph."""
    s = (style or "").lower().replace(" ", "")
    if s == "title":
        return "title", 0
    if m := re.match(r"heading(\d+)", s):
        return "heading", max(0, int(m[1]) - 1)
    return ("list_item", 0) if s.startswith("list") else ("paragraph", 0)


def _runs(node) -> str:
    """Text of `t` nodes, those of drawings left out."""
    out = []
    for x in node:
        if _name(x) == "t":
            out.append(x.text or "")
        elif _name(x) not in ("drawing", "pict"):
            out.append(_runs(x))
    return "".join(out)


def parse_docx(data: bytes) -> Parsed:
    files = zipfile.ZipFile(io.BytesIO(data))
    body = next(_all(_xml(files, "word/document.xml"), "body"))
    out: list[Element] = []

    def walk(node):
        for x in node:
            name = _name(x)
            if name == "p":
                style = next((_attr(s, "val") for s in _all(x, "pStyle")), None)
                out.extend(Element("image", "") for _ in _all(x, "drawing"))
                if t := _runs(x).strip():
                    kind, depth = style_kind(style)
                    out.append(Element(kind, t, depth))
            elif name == "tbl":
                rows = [[" ".join(t for p in _all(c, "p") if (t := _runs(p).strip())) for c in r if _name(c) == "tc"] for r in x if _name(r) == "tr"]
                if rows := [r for r in rows if r]:
                    out.append(Element("table", table(rows)))
            elif name not in ("sectPr",):
                walk(x)

    walk(body)
    return _core(files), out


def parse_pptx(data: bytes) -> Parsed:
    files = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((int(m[1]), n) for n in files.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    out: list[Element] = []
    for page, (_, name) in enumerate(slides, 1):
        for shape in _xml(files, name).iter():
            if _name(shape) == "sp":
                paras = [t for p in _all(shape, "p") if (t := _runs(p).strip())]
                role = next((_attr(p, "type") for p in _all(shape, "ph")), None)
                if paras and role in ("title", "ctrTitle"):
                    out.append(Element("title" if page == 1 else "heading", " ".join(paras), page=page))
                else:
                    out += [Element("paragraph", t, page=page) for t in paras]
            elif _name(shape) == "tbl":
                rows = [[" ".join(t for p in _all(c, "p") if (t := _runs(p).strip())) for c in r if _name(c) == "tc"] for r in _all(shape, "tr")]
                if rows:
                    out.append(Element("table", table(rows), page=page))
    return _core(files) | {"page_count": str(len(slides))}, out


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Za-z]*", ref)[0].upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def parse_xlsx(data: bytes) -> Parsed:
    """A table element for each sheet that has a cell."""
    files = zipfile.ZipFile(io.BytesIO(data))
    strings = ["".join(t.text or "" for t in _all(s, "t")) for s in _xml(files, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in files.namelist() else []
    rels = {r.get("Id"): r.get("Target") for r in _xml(files, "xl/_rels/workbook.xml.rels")}
    sheets = [(s.get("name"), rels[_attr(s, "id")]) for s in _all(_xml(files, "xl/workbook.xml"), "sheet")]
    out = []
    for name, target in sheets:
        cells: dict[int, dict[int, str]] = {}
        for y, row in enumerate(_all(_xml(files, posixpath.normpath(posixpath.join("xl", target)) if not target.startswith("/") else target[1:]), "row")):
            for x, c in enumerate(k for k in row if _name(k) == "c"):
                v, kind = next((k.text or "" for k in c if _name(k) == "v"), ""), c.get("t")
                text = "".join(t.text or "" for t in _all(c, "t")) if kind == "inlineStr" else strings[int(v)] if kind == "s" and v else {"1": "true", "0": "false"}.get(v, v) if kind == "b" else v
                at = c.get("r") or ""
                if text:
                    cells.setdefault(int(re.sub("[^0-9]", "", at) or y + 1), {})[_column(at) if at else x] = text
        if cells:
            left, right = min(min(r) for r in cells.values()), max(max(r) for r in cells.values())
            grid = [[cells.get(y, {}).get(x, "") for x in range(left, right + 1)] for y in range(min(cells), max(cells) + 1)]
            out.append(Element("table", table(grid), section=name))
    return {"page_count": str(len(sheets)), "sheet_names": ", ".join(n for n, _ in sheets)}, out


def parse_epub(data: bytes, page) -> Parsed:
    """Chapters in reading order by `page`, a function of HTML text to elements; chapters that can't be read are counted."""
    files = zipfile.ZipFile(io.BytesIO(data))
    opf = next(_all(_xml(files, "META-INF/container.xml"), "rootfile")).get("full-path")
    package = _xml(files, opf)
    meta = {"title": _first_text(package, "title"), "author": _first_text(package, "creator"), "language": _first_text(package, "language")}
    where = {i.get("id"): i.get("href") for i in _all(package, "item")}
    out = []
    for n, ref in enumerate(_all(package, "itemref"), 1):
        name = posixpath.normpath(posixpath.join(posixpath.dirname(opf), where.get(ref.get("idref")) or ""))
        if name in files.namelist():
            out += [e._replace(section=f"Chapter {n}") for e in page(files.read(name).decode(errors="replace"))]
    return {k: v for k, v in meta.items() if v}, out
