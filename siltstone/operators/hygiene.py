"""Hygiene of chunks: rejected documents, boilerplate, languages, known-exploited tags, and what each step did."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import language
from .documents import REJECTED, tag_known

# What is removed, in this order: status marks, platform URIs, lines that are a link, notes on links.
BOILERPLATE = [r"\*\*\s*REJECT\s*\*\*", r"\*\*\s*DISPUTED\s*\*\*", r"cpe:2\.3:[aho\*]:[^\s]+", r"(?md)^\s*https?://\S+\s*$", r"(?id)NOTE:\s+Links?\s+are\s+provided.*?(\n|\z)"]


def strip_boilerplate(text: Column, patterns: list[str] = BOILERPLATE) -> Column:
    """The text without the patterns; of each run of blank lines one stays, and none that is empty at the start."""
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    lines = F.transform(F.split(F.regexp_replace(text, r"\r?\n\z", ""), "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))
    blank = lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) == ""
    one = F.transform(F.array(lines), lambda a: F.filter(a, lambda x, i: ~(blank(x) & (i > 0) & blank(F.try_element_at(a, F.greatest(i, F.lit(1)))))))
    return F.regexp_replace(F.array_join(F.element_at(one, 1), "\n"), r"\A\n", "")


def chain(chunks: DataFrame, documents: DataFrame, filters: list[Callable[[Column], Column]], known: DataFrame | None = None, status: str = "vuln_status", reject: tuple = REJECTED) -> tuple[DataFrame, DataFrame]:
    """(survivors, stats) of chunks(doc_id, chunk_index, text) and documents(doc_id, status[, cve_id]).

    Documents with a rejected status go with their chunks; the filters rewrite the chunk texts in turn; chunks that are then
    blank go; the others are trimmed and counted anew. known(cve_id) flags the documents it lists. stats has one row:
    docs_rejected, chunks_stripped (length in bytes changed), chunks_lang_dropped (blank after the filters), chunks_kev_tagged.
    """
    bad = F.coalesce(F.col(status).isin(*reject), F.lit(False)) if status in documents.columns else F.lit(False)
    d = documents.withColumn("_bad", bad)
    d = tag_known(d, known, "cve_id") if known is not None else d.withColumn("kev_flag", F.lit(None).cast("boolean"))
    text = F.col("text")
    for f in filters:
        text = f(text)
    trimmed = F.regexp_replace("_t", r"\A\s+|\s+\z", "")
    # exploded, so that what is read of the new texts below does not copy the filters into every place
    c = chunks.join(d.select("doc_id", "_bad", "kev_flag"), "doc_id").where("NOT _bad").select("*", F.explode(F.array(text)).alias("_t")).select("*", F.explode(F.array(trimmed)).alias("_new"))
    out = c.where("_new <> ''").select(*[x for x in chunks.columns if x not in ("text", "char_count")], F.col("_new").alias("text"), F.octet_length("_new").cast("long").alias("char_count"), "kev_flag")
    did = c.agg(F.count_if((F.col("_new") != "") & (F.octet_length("_t") != F.octet_length("text"))).alias("chunks_stripped"), F.count_if(F.col("_new") == "").alias("chunks_lang_dropped"), F.count_if((F.col("_new") != "") & F.coalesce("kev_flag", F.lit(False))).alias("chunks_kev_tagged"))
    return out, d.agg(F.count_if("_bad").alias("docs_rejected")).crossJoin(did)  # one row each


def security_profile(chunks: DataFrame, documents: DataFrame, known: DataFrame | None = None, reject: tuple = REJECTED) -> tuple[DataFrame, DataFrame]:
    """Rejected statuses, boilerplate, then English only."""
    return chain(chunks, documents, [strip_boilerplate, language.filtered], known, reject=reject)
