"""Chunks by size, by title, recursive and semantic, hashed trigram vectors, context. Lengths are UTF-8 bytes.

A document's chunks depend on all of its text in order, so a document is one row of an Arrow batch here; documents are never
gathered. Null or blank documents give no chunk.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import documents, rendering

# Separators from the coarsest to the finest, the empty one cutting anywhere; the default context.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
CONTEXT = "{document_title} > {section}\n\n{chunk_text}"
DIMENSIONS = 256


def _spans(data: bytes, low: int, high: int, separators: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Spans of data[low:high]: neighbours between separators are joined up to the limit, larger ones cut by the next separator."""
    if high - low <= limit:
        if high > low:
            yield low, high
        return
    if not separators or not separators[0]:
        for at in range(low, high, limit):
            yield at, min(high, at + limit)
        return
    ends = [m.end() for m in re.finditer(re.escape(separators[0]), data[low:high])]
    begin = low
    start = low  # of the open span
    for end in [low + e for e in ends] + ([high] if not ends or low + ends[-1] < high else []):
        if end - start > limit:
            if begin > start:
                yield start, begin
            start = begin
            if end - begin > limit:
                yield from _spans(data, begin, end, separators[1:], limit)
                start = end
        begin = end
    if high > start:
        yield start, high


def recursive_pieces(text: str, limit: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    data = text.encode()
    return [data[a:b].decode(errors="replace") for a, b in _spans(data, 0, len(data), [s.encode() for s in separators], limit)]


def overlapped(chunks: list[str], overlap: int) -> list[str]:
    """Each chunk with the last `overlap` bytes of the one before it (as it then is) in front, from a character's start on."""
    out: list[str] = []
    for text in chunks:
        if out and overlap:
            before = out[-1].encode()
            at = max(0, len(before) - overlap)
            while at and before[at] & 0xC0 == 0x80:
                at -= 1
            text = before[at:].decode() + text
        out.append(text)
    return out


def trigram_vectors(texts: list[str]) -> np.ndarray:
    """Counts of hashed character trigrams, a row a text; shorter texts count their characters by place."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, t in zip(out, texts):
        c = np.frombuffer(t.lower().encode("utf-32-le"), np.uint32).astype(np.int64)
        if len(c) < 3:
            np.add.at(row, c % DIMENSIONS, np.arange(1, len(c) + 1, dtype=np.float32))
        else:
            row += np.bincount(((c[:-2] * 31 + c[1:-1]) * 31 + c[2:]) % DIMENSIONS, minlength=DIMENSIONS).astype(np.float32)
    return out


def sentences(texts: list[str]) -> list[str]:
    found = []
    for t in texts:
        found += [s.strip() for s in re.split(r"(?<=\. )", t.strip())]
    return [s for s in found if s]


def semantic_pieces(texts: list[str], limit: int, threshold: float | None = None, percentile: float | None = None, embed: Callable[[list[str]], np.ndarray] = trigram_vectors) -> list[str]:
    """Sentences, parted where the cosine of neighbours is under a threshold: given, or a percentile of all of them, or 0.5."""
    if not texts:
        return []
    said = sentences(texts)
    if len(said) < 2:
        return ["\n".join(texts)]
    v = np.asarray(embed(said), np.float32)
    norm = np.sqrt((v * v).sum(1))
    scale = norm[:-1] * norm[1:]
    near = np.divide((v[:-1] * v[1:]).sum(1), scale, out=np.zeros(len(scale), np.float32), where=scale > 0)
    if threshold is None:
        threshold = 0.5
        if percentile is not None:
            threshold = np.sort(near)[min(len(near) - 1, max(0, math.floor(percentile / 100 * (len(near) - 1) + 0.5)))]
    out = []
    for group in np.split(np.array(said, object), np.flatnonzero(near < np.float32(threshold)) + 1):
        first = len(out)
        for s in group.tolist():
            if len(out) > first and len(out[-1].encode()) + 1 + len(s.encode()) <= limit:
                out[-1] += " " + s
            else:
                out.append(s)
    return out


def basic_pieces(texts: list[str], limit: int) -> list[str]:
    """Texts joined by line ends while their bytes (without line ends) are within the limit; a text is never split."""
    ends = np.cumsum([len(t.encode()) for t in texts])
    out, at = [], 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        out.append("\n".join(texts[at:stop]))
        at = stop
    return out


def titled_pieces(kinds: list[str], texts: list[str], limit: int) -> list[tuple[str | None, str]]:
    """(section, text): a section begins with each title or heading; larger ones are cut as by basic_pieces."""
    heads = [i for i, k in enumerate(kinds) if k in ("title", "heading")]
    out = []
    for a, b in zip([0, *heads], [*heads, len(texts)]):
        if b > a:
            out += [(texts[a] if kinds[a] in ("title", "heading") else None, t) for t in basic_pieces(texts[a:b], limit)]
    return out


def _chunked(elements: DataFrame, pieces: Callable[[list[str], list[str]], list[tuple[str | None, str]]], overlap: int = 0) -> DataFrame:
    """(doc_id, chunk_index, section, text, char_count) by a function of a document's kinds and texts in order."""
    kind = elements.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (kinds, texts) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                made = pieces(kinds, [t or "" for t in texts])
                text = overlapped([t for _, t in made], overlap)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(made), pa.int64())), pa.array(range(len(made)), pa.int64()), pa.array([s for s, _ in made], pa.string()), pa.array(text, pa.string()), pa.array([len(x.encode()) for x in text], pa.int64())], names=["doc_id", "chunk_index", "section", "text", "char_count"])

    rows = elements.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "text"))).alias("x"))
    return rows.select("doc_id", F.col("x")["kind"].alias("k"), F.col("x")["text"].alias("t")).mapInArrow(run, f"doc_id {kind}, chunk_index long, section string, text string, char_count long")


def chunk_basic(elements: DataFrame, limit: int, overlap: int = 0) -> DataFrame:
    """(doc_id, chunk_index, text, char_count): greedy chunks, each with the last `overlap` bytes of the chunk before it in front."""
    return _chunked(elements, lambda _, texts: [(None, t) for t in basic_pieces(texts, limit)], overlap).drop("section")


def chunk_by_title(elements: DataFrame, limit: int, overlap: int = 0) -> DataFrame:
    """(doc_id, chunk_index, section, text, char_count)"""
    return _chunked(elements, lambda kinds, texts: titled_pieces(kinds, texts, limit), overlap)


def chunk_recursive(elements: DataFrame, limit: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """(doc_id, chunk_index, text, char_count)"""
    return _chunked(elements, lambda _, texts: [(None, t) for t in recursive_pieces("\n".join(texts), limit, separators)], overlap).drop("section")


def chunk_semantic(elements: DataFrame, limit: int = 1000, threshold: float | None = None, percentile: float | None = None, embed: Callable[[list[str]], np.ndarray] = trigram_vectors) -> DataFrame:
    """(doc_id, chunk_index, text, char_count)"""
    return _chunked(elements, lambda _, texts: [(None, t) for t in semantic_pieces(texts, limit, threshold, percentile, embed)]).drop("section")


def with_context(chunks: DataFrame, titles: DataFrame, template: str = CONTEXT) -> DataFrame:
    """chunks(doc_id, text[, section]) with titles(doc_id, title) put into their text by the template, and counted anew."""
    section = F.col("section") if "section" in chunks.columns else F.lit(None)
    j = chunks.join(titles.select(F.col("doc_id").alias("_d"), F.col("title").alias("_title")), F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    j = j.withColumn("text", documents.context(template, F.col("_title"), section, F.col("text")))
    return j.withColumn("char_count", F.octet_length("text").cast("long")).drop("_d", "_title")


def chunk(elements: DataFrame, strategy: str = "recursive", limit: int = 1000, overlap: int = 200, **more) -> DataFrame:
    """Chunks by name of the strategy: basic, by-title, recursive or semantic."""
    if strategy == "basic":
        return chunk_basic(elements, limit, overlap)
    if strategy == "by-title":
        return chunk_by_title(elements, limit, overlap)
    if strategy == "recursive":
        return chunk_recursive(elements, limit, overlap, **more)
    if strategy == "semantic":
        return chunk_semantic(elements, limit, **more)
    raise ValueError(f"no chunking strategy is called {strategy!r}")


def chunk_and_render(elements: DataFrame, strategy: str = "recursive", output: str = "markdown", **how) -> DataFrame:
    """(doc_id, rendered): the chunks of each document as one text."""
    return rendering.render_chunks(chunk(elements, strategy, **how), output)
