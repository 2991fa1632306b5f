"""Parsers of tables of texts: HTML pages, tables to Markdown."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SKIP = {"script", "style", "nav", "header", "footer", "noscript", "svg"}
_KINDS = {"p": "paragraph", "li": "list_item", "pre": "code", "blockquote": "quote", "h1": "title", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "figure": "image", "img": "image", "table": "table"}


class _Page(HTMLParser):
    """Elements in document order, of the article or main part if there is one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.open, self.main, self.in_title, self.title = 0, [], 0, False, None
        self.all: list[tuple[str, int, str, bool]] = []
        self.rows: list[list[str]] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        self.main += tag in ("article", "main")
        self.in_title |= tag == "title" and self.title is None
        if tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append("")
        elif tag == "img" and not self.skip:
            self.all.append(("image", 0, dict(attrs).get("alt") or "", self.main > 0))
        elif tag in _KINDS and tag != "figure":
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        if tag in _SKIP and self.skip:
            self.skip -= 1
        if tag == "title":
            self.in_title = False
        if tag == "table" and self.rows is not None:
            rows, self.rows = [r for r in self.rows if r], None
            if rows and not self.skip:
                line = lambda r: "| " + " | ".join(x.strip() for x in r) + " |"
                self.all.append(("table", 0, "\n".join([line(rows[0]), "|" + " --- |" * len(rows[0]), *map(line, rows[1:])]), self.main > 0))
        if self.open and self.open[-1][0] == tag:
            _, parts = self.open.pop()
            text = " ".join("".join(parts).split())
            if text and not self.skip:
                self.all.append((_KINDS[tag], int(tag[1]) - 1 if tag[0] == "h" and tag[1:].isdigit() else 0, text, self.main > 0))
        self.main -= tag in ("article", "main") and self.main > 0

    def handle_data(self, data):
        if self.in_title:
            self.title = (self.title or "") + data
        elif self.skip:
            return
        elif self.rows and self.rows[-1]:
            self.rows[-1][-1] += data
        elif self.open:
            self.open[-1][1].append(data)


def parse_html(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, kind, depth, text, title): elements in order, a page's title on each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, h in zip(b.iloc[:, 0], b.iloc[:, 1]):
                p = _Page()
                p.feed(h or "")
                p.close()
                found = [x for x in p.all if x[3]] or p.all
                out += [(k, i, kind, depth, text, p.title) for i, (kind, depth, text, _) in enumerate(found)]
            yield pd.DataFrame(out, columns=[key, "pos", "kind", "depth", "text", "title"])

    return pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, pos long, kind string, depth long, text string, title string")


def html_title(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    return pages.select(key, F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1).alias("title"))


def table_markdown(rows: DataFrame, columns: list[str], order: str, per: int = 100) -> DataFrame:
    """(part, markdown): Markdown tables of `per` rows in the order of a dense row number column starting at 0."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"
    g = rows.select(F.floor(F.col(order) / per).cast("long").alias("part"), F.col(order).alias("_o"), line.alias("_l")).groupBy("part").agg(F.expr("array_join(transform(array_sort(collect_list(struct(_o, _l))), x -> x._l), '\n')").alias("_b"))
    return g.select("part", F.concat(F.lit(head), "_b").alias("markdown"))
