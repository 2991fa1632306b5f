"""File formats by content and name, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The known formats and the extensions of each.
EXTENSIONS = {
    "pdf": ["pdf"],
    "html": ["html", "htm", "xhtml"],
    "markdown": ["md", "markdown", "mkd"],
    "csv": ["csv", "tsv"],
    "text": ["txt", "text", "log"],
    "docx": ["docx"],
    "pptx": ["pptx"],
    "xlsx": ["xlsx"],
    "xml": ["xml"],
    "epub": ["epub"],
    "rtf": ["rtf"],
    "email": ["eml"],
}
#: Characters at the start of the content that are looked at.
HEAD = 512
EXTENSION = r"[^/]\.([^./]*)\z"


def detect(path: Column, content: Column) -> Column:
    """Format of a file: feed markers in the content, then the extension, then the content's first characters, else unknown.

    Null path or content: as empty.
    """
    head = F.substring(F.coalesce(content, F.lit("")), 1, HEAD)
    has = lambda s: head.contains(s)
    found = F.when(has('"NVD_CVE"') | (has('"vulnerabilities"') & has('"format"')), "nvd_feed")
    extension = F.regexp_extract(F.lower(F.coalesce(path, F.lit(""))), EXTENSION, 1)
    for name, ends in EXTENSIONS.items():
        found = found.when(extension.isin(ends), name)
    found = found.when(head.startswith("%PDF"), "pdf")
    return found.when(head.rlike(r"^\s*<\?xml"), "xml").when(head.rlike(r"^\s*<(!DOCTYPE|html|HTML)"), "html").otherwise("unknown")


def detect_sql(path: str, content: str) -> str:
    """The same in DuckDB SQL."""
    head, ext = f"coalesce({content}, '')[1:{HEAD}]", f"regexp_extract(lower(coalesce({path}, '')), '{EXTENSION}', 1)"
    has = lambda s: f"contains({head}, '{s}')"
    ends = " ".join(f"WHEN {ext} IN ({', '.join(map(repr, v))}) THEN '{k}'" for k, v in EXTENSIONS.items())
    return f"""CASE WHEN {has('"NVD_CVE"')} OR ({has('"vulnerabilities"')} AND {has('"format"')}) THEN 'nvd_feed' {ends}
WHEN starts_with({head}, '%PDF') THEN 'pdf' WHEN regexp_matches({head}, '^\\s*<\\?xml') THEN 'xml' WHEN regexp_matches({head}, '^\\s*<(!DOCTYPE|html|HTML)') THEN 'html' ELSE 'unknown' END"""
