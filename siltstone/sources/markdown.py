"""Markdown texts to elements: one pass over the lines of each text, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEAD = re.compile(r" {0,3}(#{1,6})(?:[ \t](.*))?$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^\s`]*)")
_ITEM = re.compile(r"\s*(?:[-*+]|\d{1,9}[.)])[ \t]+(.*)")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_DASHES = re.compile(r":?-+:?$")
_FRONT = re.compile(r"---[ \t]*\n(?:.*\n)*?---[ \t]*(?:\n|$)")


def _heading(text: str) -> str:
    """Without the closing marks, which stand apart or alone."""
    text = text.strip()
    bare = text.rstrip("#")
    return bare.rstrip() if not bare or bare[-1] in " \t" else text


def _divides(line: str) -> bool:
    """A table's second row."""
    line = line.strip()
    return "|" in line and all(_DASHES.match(c.strip()) for c in line.removeprefix("|").removesuffix("|").split("|"))


class FrontmatterError(ValueError):
    pass


_PAIR = re.compile(r"([^\s:#][^:]*?)\s*:(?:\s+(.*))?$")


def _scalar(value: str) -> str | None:
    """A YAML scalar as a string: quotes and comments taken off, nulls left out; collections are an error."""
    value = value.strip()
    if value[:1] == "'" and (end := re.match(r"'((?:[^']|'')*)'\s*(?:#.*)?$", value)):
        return end[1].replace("''", "'")
    if value[:1] == '"' and (end := re.match(r'"((?:[^"\\]|\\.)*)"\s*(?:#.*)?$', value)):
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), end[1])
    value = re.sub(r"(^|\s)#.*$", "", value).strip()
    if value[:1] in ("[", "{", "|", ">", "&", "*"):
        raise FrontmatterError(f"frontmatter values must be scalars, not {value!r}")
    if value in ("", "~", "null", "Null", "NULL"):
        return None
    return value.lower() if value in ("True", "TRUE", "False", "FALSE") else value


def frontmatter(text: str) -> tuple[dict[str, str], str]:
    """(values, body): the scalars of a leading `---` block as strings. A block that is not closed is text."""
    text = text.replace("\r\n", "\n")
    if not (front := _FRONT.match(text)):
        return {}, text
    out, key = {}, None
    for line in front[0].strip().split("\n")[1:-1]:
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line[0] in " \t-":
            raise FrontmatterError("frontmatter values must be scalars")
        if not (m := _PAIR.match(line)):
            raise FrontmatterError(f"frontmatter must be a mapping, not {line!r}")
        key = m[1].strip("'\"")
        if (value := _scalar(m[2] or "")) is not None:
            out[key] = value
    return out, text[front.end() :]


def elements(text: str) -> list[tuple[str, int, str, str | None]]:
    """(kind, depth, text, language) in order. A frontmatter block at the start is no element."""
    text = text.replace("\r\n", "\n")
    if front := _FRONT.match(text):
        text = text[front.end() :]
    out: list[tuple[str, int, str, str | None]] = []
    lines, at, para = text.split("\n"), 0, []

    def close():
        if para:
            out.append(("paragraph", 0, "\n".join(para), None))
            para.clear()

    while at < len(lines):
        line = lines[at]
        at += 1
        if not line.strip():
            close()
        elif m := _FENCE.match(line):
            close()
            body = []
            while at < len(lines) and not ((s := lines[at].strip()) and set(s) == {m[1][0]} and len(s) >= len(m[1])):
                body.append(lines[at])
                at += 1
            at += 1
            out.append(("code", 0, "\n".join(body), m[2] or None))
        elif m := _HEAD.match(line):
            close()
            level = len(m[1])
            out.append(("title" if level == 1 else "heading", level - 1, _heading(m[2] or ""), None))
        elif _RULE.match(line):
            close()
            out.append(("horizontal_rule", 0, "", None))
        elif line.lstrip().startswith(">"):
            close()
            body = [line]
            while at < len(lines) and lines[at].lstrip().startswith(">"):
                body.append(lines[at])
                at += 1
            out.append(("quote", 0, "\n".join(x.lstrip()[1:].strip() for x in body), None))
        elif m := _ITEM.match(line):
            close()
            out.append(("list_item", 0, m[1].strip(), None))
        elif "|" in line and at < len(lines) and _divides(lines[at]):
            close()
            rows = [line.strip()]
            while at < len(lines) and "|" in lines[at]:
                rows.append(lines[at].strip())
                at += 1
            out.append(("table", 0, "\n".join(rows), None))
        else:
            para.append(line.strip())
    close()
    return out


def parse_markdown(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pos, kind, depth, text, language). Null or blank text: no elements. Repeated ids: each row's elements."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, p, *e) for i, t in zip(b["_id"], b["_t"]) for p, e in enumerate(elements(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "kind", "depth", "text", "language"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).mapInPandas(run, f"doc_id {kind}, pos long, kind string, depth int, text string, language string")
