"""Element and chunk tables as texts: Markdown, HTML, plain text, JSON. Built-in functions only; one ordered fold a document.

elements(doc_id, pos, kind, depth, text) may have `attrs`, a map of strings (language, alt, field_name, field_type,
reference_id). Kinds are those of the parsers; others are treated as paragraphs. Null texts are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File ending of each output.
ENDINGS = {"markdown": "md", "json": "json", "jsonl": "jsonl", "text": "txt", "html": "html"}


def _attr(elements: DataFrame, name: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit("")) if "attrs" in elements.columns else F.lit("")


def _cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _joined(elements: DataFrame, line: Column, name: str, before: str = "", after: str = "", trim: bool = True) -> DataFrame:
    d = elements.select("doc_id", F.struct("pos", line.alias("s")).alias("x")).groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("e"))
    out = F.array_join(F.col("e")["s"], "")
    out = F.regexp_replace(out, r"\s+\z", "") if trim else out
    return d.select("doc_id", _cat(before, out, after).alias(name))


def markdown_line(elements: DataFrame) -> Column:
    t, kind = F.coalesce("text", F.lit("")), F.col("kind")
    hashes = F.repeat(F.lit("#"), F.greatest(F.col("depth"), F.lit(1)).cast("int") + 1)
    name, type_, ref = _attr(elements, "field_name"), _attr(elements, "field_type"), _attr(elements, "reference_id")
    quoted = F.concat(F.regexp_replace(F.regexp_replace(t, r"\r?\n\z", ""), r"(?m)^", "> "), F.lit("\n\n"))
    return (
        F.when(kind == "title", _cat("# ", t, "\n\n"))
        .when(kind == "heading", _cat(hashes, " ", t, "\n\n"))
        .when(kind == "code", _cat("```", _attr(elements, "language"), "\n", t, "\n```\n\n"))
        .when(kind == "list_item", _cat("- ", t, "\n"))
        .when(kind == "image", _cat("![", _attr(elements, "alt"), "](", t, ")\n\n"))
        .when(kind == "quote", F.when(t == "", F.lit("\n")).otherwise(quoted))
        .when(kind == "horizontal_rule", F.lit("---\n\n"))
        .when(kind == "form_field", _cat("**", name, F.when(type_ == "", "**: ").otherwise(_cat("** (", type_, "): ")), t, "\n\n"))
        .when(kind == "footnote", _cat("[^", ref, "]: ", t, "\n\n"))
        .otherwise(_cat(t, "\n\n"))
    )


def to_markdown(elements: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(doc_id, markdown). With titles(doc_id, title), the title stands first where the first element is none."""
    if titles is None:
        return _joined(elements, markdown_line(elements), "markdown")
    first = elements.groupBy("doc_id").agg(F.min_by("kind", "pos").alias("_k")).join(titles.select("doc_id", "title"), "doc_id").where("_k <> 'title' AND title IS NOT NULL")
    head = first.select("doc_id", F.lit(-1).cast(elements.schema["pos"].dataType).alias("pos"), _cat("# ", F.col("title"), "\n\n").alias("s"))
    rows = elements.select("doc_id", "pos", markdown_line(elements).alias("s")).unionByName(head)
    return _joined(rows, F.col("s"), "markdown")


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_table(markdown: Column) -> Column:
    """A Markdown table's rows as an HTML table, the first one as its head; rules between rows are left out."""
    rows = F.filter(F.split(markdown, r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^[|\-: ]*$"))
    cells = F.transform(rows, lambda x: F.transform(F.filter(F.split(F.trim(x), r"\|"), lambda c: c != ""), lambda c: escaped(F.trim(c))))
    tagged = F.transform(cells, lambda r, i: F.when(i == 0, F.array_join(F.transform(r, lambda c: _cat("<th>", c, "</th>")), "")).otherwise(F.array_join(F.transform(r, lambda c: _cat("<td>", c, "</td>")), "")))
    return _cat("<table>\n", F.array_join(F.transform(tagged, lambda r: _cat("<tr>", r, "</tr>\n")), ""), "</table>")


def html_line(elements: DataFrame) -> Column:
    raw, kind = F.coalesce("text", F.lit("")), F.col("kind")
    t = escaped(raw)
    level = F.least(F.greatest(F.col("depth"), F.lit(1)) + 1, F.lit(6)).cast("string")
    lang, ref, type_ = _attr(elements, "language"), _attr(elements, "reference_id"), escaped(_attr(elements, "field_type"))
    line = (
        F.when(kind == "title", _cat("<h1>", t, "</h1>"))
        .when(kind == "heading", _cat("<h", level, ">", t, "</h", level, ">"))
        .when(kind == "table", html_table(raw))
        .when(kind == "code", _cat("<pre><code", F.when(lang == "", "").otherwise(_cat(' class="', lang, '"')), ">", t, "</code></pre>"))
        .when(kind == "list", _cat("<ul>", t, "</ul>"))
        .when(kind == "list_item", _cat("<li>", t, "</li>"))
        .when(kind == "image", _cat('<img src="', t, '" alt="', _attr(elements, "alt"), '">'))
        .when(kind == "quote", _cat("<blockquote><p>", t, "</p></blockquote>"))
        .when(kind == "horizontal_rule", F.lit("<hr>"))
        .when(kind == "form_field", _cat("<dl><dt>", escaped(_attr(elements, "field_name")), F.when(type_ == "", "").otherwise(_cat(" (", type_, ")")), "</dt><dd>", t, "</dd></dl>"))
        .when(kind == "footnote", _cat('<aside class="footnote"', F.when(ref == "", "").otherwise(_cat(' id="', ref, '"')), ">", t, "</aside>"))
        .otherwise(_cat("<p>", t, "</p>"))
    )
    return F.concat(line, F.lit("\n"))


def to_html(elements: DataFrame) -> DataFrame:
    """(doc_id, html): a whole page."""
    return _joined(elements, html_line(elements), "html", "<!DOCTYPE html>\n<html>\n<body>\n", "</body>\n</html>", trim=False)


def to_plain_text(elements: DataFrame) -> DataFrame:
    return _joined(elements, F.when(F.coalesce("text", F.lit("")) == "", "").otherwise(_cat(F.col("text"), "\n")), "plain")


def _fields(elements: DataFrame) -> Column:
    return F.struct(*[c for c in elements.columns if c != "doc_id"])


def to_jsonl(elements: DataFrame) -> DataFrame:
    """(doc_id, jsonl): an object a line for each element."""
    return _joined(elements, _cat(F.to_json(_fields(elements)), "\n"), "jsonl")


def to_json(elements: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """(doc_id, json): metadata(doc_id, ...) of the document, and its elements in order."""
    d = elements.groupBy("doc_id").agg(F.array_sort(F.collect_list(_fields(elements))).alias("elements"))
    if metadata is not None:
        d = d.join(metadata.select("doc_id", F.struct(*[c for c in metadata.columns if c != "doc_id"]).alias("metadata")), "doc_id", "left").select("doc_id", "metadata", "elements")
    return d.select("doc_id", F.to_json(F.struct(*[c for c in d.columns if c != "doc_id"])).alias("json"))


def render_chunks(chunks: DataFrame, output: str = "markdown") -> DataFrame:
    """chunks(doc_id, chunk_index, text[, char_count, section]) -> (doc_id, rendered)"""
    section = F.col("section").cast("string") if "section" in chunks.columns else F.lit(None).cast("string")
    count = F.col("char_count") if "char_count" in chunks.columns else F.octet_length("text").cast("long")
    if output in ("json", "jsonl"):
        line = _cat(F.to_json(F.struct(F.col("chunk_index").alias("index"), count.alias("char_count"), section.alias("section"), "text"), {"ignoreNullFields": "false"}), "\n")
    elif output == "html":
        line = _cat(F.coalesce(_cat("<h2>", section, "</h2>\n"), F.lit("")), "<p>", F.col("text"), "</p>\n<hr>\n")
    elif output == "text":
        line = _cat(F.col("text"), "\n\n")
    elif output == "markdown":
        line = _cat(F.coalesce(_cat("## ", section, "\n\n"), F.lit("")), F.col("text"), "\n\n---\n\n")
    else:
        raise ValueError(f"no output is called {output!r}")
    return _joined(chunks.withColumnRenamed("chunk_index", "pos") if "pos" not in chunks.columns and output not in ("json", "jsonl") else chunks.withColumn("pos", F.col("chunk_index")), line, "rendered")


def output_path(path: Column, folder: str, output: str) -> Column:
    """Where a file's rendering goes: its own name and the output's ending, in the folder."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_extract(path, r"([^/]*)/*$", 1), F.lit("." + ENDINGS[output]))
