"""Directories of files to documents and elements: scan, registry of parsers, metadata overlays.

Files are read by Spark's binary source, so any store that Spark reaches will do; the parsers run in Arrow batches. A file
that can't be parsed gives a row with its error and no elements. Null content: an error row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import slices
from . import formats, markdown, markup, office, parsers
from .markup import Element, Parsed

SIDECAR = ".meta.json"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, modified, content, format) of the files below a folder whose format is known; metadata sidecars are no files of their own."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    head = F.decode(F.substring("content", 1, formats.HEAD), "iso-8859-1")
    ending = F.lower(F.regexp_extract("path", formats.EXTENSION, 1))
    f = f.where(~F.col("path").endswith(SIDECAR)).withColumn("format", formats.detect(F.col("path"), head))
    return f.where((F.col("format") != "unknown") | (ending == "json")).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content", "format")


def format_table(spark: SparkSession) -> DataFrame:
    """(format, extensions) of every known format."""
    return spark.createDataFrame([(k, v) for k, v in formats.EXTENSIONS.items()], "format string, extensions array<string>")


def _html_elements(html: str) -> tuple[str | None, list[Element]]:
    p = parsers._Page()
    p.feed(html)
    p.close()
    notes, refs = markup.html_notes(html)
    found = [Element(kind, text, depth, attrs={"footnote_refs": refs[text]} if kind == "paragraph" and text in refs else {}) for kind, depth, text, _ in ([x for x in p.all if x[3]] or p.all)]
    return p.title, found + notes


def parse_html(data: bytes) -> Parsed:
    title, found = _html_elements(data.decode(errors="replace"))
    return ({"title": title} if title else {}), found


def parse_markdown(data: bytes) -> Parsed:
    text = data.decode("utf-8-sig", "replace")
    meta, body = markdown.frontmatter(text)
    found = [Element(kind, t, depth, attrs={"language": lang} if lang else {}) for kind, depth, t, lang in markdown.elements(body)]
    title = next((e.text for e in found if e.kind == "title"), None)
    return ({"title": title} if title else {}) | meta, found


def parse_epub(data: bytes) -> Parsed:
    return office.parse_epub(data, lambda html: _html_elements(html)[1])


#: Parser of each format: bytes to (metadata, elements). Others can be added or put in place of these.
REGISTRY: dict[str, Callable[[bytes], Parsed]] = {
    "text": markup.parse_text, "csv": markup.parse_csv, "markdown": parse_markdown, "html": parse_html, "xml": markup.parse_xml, "email": markup.parse_email,
    "rtf": markup.parse_rtf, "docx": office.parse_docx, "pptx": office.parse_pptx, "xlsx": office.parse_xlsx, "epub": parse_epub,
}

_ELEMENT = pa.struct([("kind", pa.string()), ("text", pa.string()), ("depth", pa.int64()), ("section", pa.string()), ("page", pa.int64()), ("attrs", pa.map_(pa.string(), pa.string()))])
SCHEMA = "path string, format string, title string, metadata map<string,string>, elements array<struct<kind:string,text:string,depth:bigint,section:string,page:bigint,attrs:map<string,string>>>, error string"


def parse(files: DataFrame, registry: dict[str, Callable[[bytes], Parsed]] | None = None) -> DataFrame:
    """files(path, content, format) -> SCHEMA, a row a file. A worker holds the elements of a slice of its files."""
    registry = REGISTRY if registry is None else registry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1)):
            out = []
            for path, content, kind in zip(*(b.column(i).to_pylist() for i in range(3))):
                meta, found, error = {}, [], None
                if kind not in registry:
                    error = f"no parser for the format {kind}"
                elif content is None:
                    error = "no content"
                else:
                    try:
                        meta, found = registry[kind](content)
                    except Exception as e:  # noqa: BLE001 - one file's fault is its own row's
                        error = f"{type(e).__name__}: {e}"
                title = meta.get("title")
                rows = [e._asdict() | {"attrs": list(e.attrs.items())} for e in found]
                out.append((path, kind, title, [(k, v) for k, v in meta.items() if v is not None], rows, error))
            cols = list(zip(*out)) if out else [[]] * 6
            types = (pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(_ELEMENT), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["path", "format", "title", "metadata", "elements", "error"])

    return files.select("path", "content", "format").mapInArrow(run, SCHEMA)


def elements(parsed: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, depth, text, section, page, attrs): doc_id is the path."""
    return parsed.select(F.col("path").alias("doc_id"), F.posexplode("elements").alias("pos", "e")).select("doc_id", F.col("pos").cast("long").alias("pos"), "e.kind", "e.depth", "e.text", "e.section", "e.page", "e.attrs")


def sidecar_path(path: Column) -> Column:
    """Beside the file: its name without the last ending, and the sidecar's."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*\z", ""), F.lit(SIDECAR))


class SidecarError(ValueError):
    pass


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """(path, metadata): each sidecar below a folder; one that is no flat object of strings is an error when read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*" + SIDECAR).load(folder)
    j = f.select("path", F.decode("content", "utf-8").alias("j"))
    v = F.expr("try_parse_json(j)")
    flat = F.expr("coalesce(schema_of_variant(try_parse_json(j)) LIKE 'OBJECT%', false)") & v.isNotNull()
    m = F.expr("cast(try_parse_json(j) AS map<string, variant>)")
    strings = F.forall(F.map_values(m), lambda x: F.schema_of_variant(x) == "STRING")
    bad = F.concat(F.lit("metadata must be a flat object of strings: "), F.col("path"))
    return j.select("path", F.when(flat, m).alias("m"), F.when(flat, strings).otherwise(False).alias("ok"), bad.alias("bad")).select("path", F.when(F.col("ok"), F.expr("transform_values(m, (k, x) -> variant_get(x, '$', 'string'))")).otherwise(F.raise_error(F.col("bad")).cast("map<string,string>")).alias("metadata"))


def overlaid(*maps: Column) -> Column:
    """One map of several, the last one that has a key wins: given values, then the sidecar's, then the file's own."""
    kept = F.array(*[F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>")) for m in maps])
    every = F.flatten(kept)
    last = F.filter(every, lambda x, i: ~F.exists(F.slice(every, i + 2, F.size(every)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def with_metadata(parsed: DataFrame, side: DataFrame | None = None, given: dict[str, str] | None = None) -> DataFrame:
    """parsed with its metadata overlaid on its sidecar's and on the given values."""
    base = F.create_map(*[F.lit(x) for p in (given or {}).items() for x in p]).cast("map<string,string>")
    d = parsed.withColumn("_s", sidecar_path(F.col("path")))
    if side is None:
        d = d.withColumn("_side", F.lit(None).cast("map<string,string>"))
    else:
        d = d.join(side.select(F.col("path").alias("_s"), F.col("metadata").alias("_side")), "_s", "left")
    return d.withColumn("metadata", overlaid(base, F.col("_side"), F.col("metadata"))).select(*parsed.columns)
