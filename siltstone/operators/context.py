"""Context of chunks: a text by a model that situates each chunk, kept in a cache that later runs reuse.

The cache is a table (chunk_hash, ctx_version, model_id, prompt_version, raw_text, doc_title, context_text, status, error); the
first four columns are its key. A contextualizer is an object with `model`, `prompt_version` and `context(title, text) -> str`;
none is bundled, as there is no model here. It runs in Arrow batches, and only for chunks that the cache has no row for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = 1
ERROR_BYTES = 500
KEY = ["chunk_hash", "ctx_version", "model_id", "prompt_version"]
CACHE = "chunk_hash string, ctx_version int, model_id string, prompt_version int, raw_text string, doc_title string, context_text string, status string, error string"
PROMPT = "<document><title>{doc_title}</title></document>\n<chunk>\n{chunk}\n</chunk>\n\nSay in one or two sentences what this passage is about and where in the document it belongs, so that a search finds it. Answer with these sentences only."


class ContextError(RuntimeError):
    pass


def prompt(title: str, chunk: str, template: str = PROMPT) -> str:
    return template.replace("{doc_title}", title).replace("{chunk}", chunk)


def prompt_hash(template: str = PROMPT) -> str:
    import hashlib

    return hashlib.sha256(template.encode()).hexdigest()


def keyed(chunks: DataFrame, contextualizer) -> DataFrame:
    """chunks(text, title, ...) with the cache's key."""
    return chunks.withColumns({"chunk_hash": F.sha2("text", 256), "ctx_version": F.lit(VERSION), "model_id": F.lit(contextualizer.model), "prompt_version": F.lit(contextualizer.prompt_version)})


def _ask(misses: DataFrame, contextualizer) -> DataFrame:
    """Rows of CACHE for misses(key, raw_text, doc_title)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = []
            for text, title in zip(b.column(4).to_pylist(), b.column(5).to_pylist()):
                try:
                    said.append((contextualizer.context(title or "", text), "ok", None))
                except Exception as e:  # noqa: BLE001 - a chunk's failure is its row's
                    said.append((None, "failed", shortened(str(e))))
            cols = list(zip(*said)) if said else [[], [], []]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(6)), *(pa.array(list(c), pa.string()) for c in cols)], names=[*KEY, "raw_text", "doc_title", "context_text", "status", "error"])

    return misses.select(*KEY, "raw_text", "doc_title").mapInArrow(run, CACHE)


def shortened(error: str) -> str:
    data = error.encode()
    return error if len(data) <= ERROR_BYTES else data[:ERROR_BYTES].decode(errors="ignore") + "…"


def new_rows(chunks: DataFrame, cache: DataFrame, contextualizer) -> DataFrame:
    """Cache rows of the chunks that the cache does not hold, each text once. Write these to the cache, then read contexts by with_contexts()."""
    k = keyed(chunks, contextualizer).select(*KEY, F.col("text").alias("raw_text"), F.col("title").alias("doc_title")).dropDuplicates(KEY)
    return _ask(k.join(cache.select(*KEY), KEY, "left_anti"), contextualizer)


def with_contexts(chunks: DataFrame, cache: DataFrame, contextualizer, strict: bool = False) -> DataFrame:
    """chunks with contextualized_text: the context, a blank line, the text; null where the context failed, or an error if strict."""
    k = keyed(chunks, contextualizer)
    c = cache.select(*KEY, "context_text", "status", "error")
    j = k.join(c, KEY, "left")
    good = (F.col("status") == "ok") & F.col("context_text").isNotNull()
    text = F.when(good, F.concat("context_text", F.lit("\n\n"), "text"))
    if strict:
        text = F.when(good, text).otherwise(F.raise_error(F.coalesce("error", F.lit("no context"))).cast("string"))
    return j.withColumn("contextualized_text", text).drop("context_text", "status", "error", *KEY)


def upserted(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """The cache with the rows put in the place of those of the same key."""
    return cache.join(rows.select(*KEY), KEY, "left_anti").unionByName(rows)


def retried(cache: DataFrame, contextualizer) -> DataFrame:
    """The failed rows asked again; upsert them, and report them by status."""
    return _ask(cache.where("status = 'failed'"), contextualizer)


def counts(cache: DataFrame) -> DataFrame:
    """One row: (ok, failed)"""
    return cache.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"))
