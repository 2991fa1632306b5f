"""Text vectors: interface, prefixes, batching by length, and a deterministic hashing embedder.

An embedder is any object with `dim`, `model`, `query_prefix`, `passage_prefix` and `vectors(texts) -> array`; servers and
models are plugged in by such objects, none is bundled. Texts go through it in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices

# FNV-1a, 64 bits.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
BATCH = 64


def fnv(data: bytes) -> int:
    h = OFFSET
    for b in data:
        h = (h ^ b) * PRIME & (1 << 64) - 1
    return h


def prefix_hash(query: str, passage: str) -> int:
    """Of a prefix pair, to tell corpora of different pairs apart."""
    return fnv(query.encode() + b"\0" + passage.encode())


@dataclass(frozen=True)
class HashEmbedder:
    """Signed hashes of the byte trigrams of the lower-cased text, of length one; for tests and as a stand-in."""

    dim: int = 16
    model: str = "hash-16"
    query_prefix: str = ""
    passage_prefix: str = ""

    def vectors(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, t in zip(out, texts):
            b = np.frombuffer(t.lower().encode(), np.uint8).astype(np.uint64)
            if len(b) < 3:
                for i, x in enumerate(b.tolist()):
                    row[(x + i) % self.dim] += 1
            else:
                h = np.full(len(b) - 2, OFFSET, np.uint64)
                for k in range(3):
                    h = (h ^ b[k : len(b) - 2 + k]) * np.uint64(PRIME)
                sign = np.where(h >> np.uint64(63), -1.0, 1.0)
                row += np.bincount((h % np.uint64(self.dim)).astype(np.int64), sign, self.dim).astype(np.float32)
            if (n := np.sqrt((row * row).sum())) > 0:
                row /= n
        return out


def embed(rows: DataFrame, text: str, embedder=HashEmbedder(), role: str = "passage", batch: int = BATCH, name: str = "v") -> DataFrame:
    """rows with a vector of each text (null: of an empty one), which is put behind the role's prefix. Rows of a partition are sorted by length first, so that a batch's texts are alike."""
    prefix = {"query": embedder.query_prefix, "passage": embedder.passage_prefix}[role]
    kept = rows.columns
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, whole.num_columns - 1)):
            texts = b.column(b.num_columns - 1).to_pylist()
            v = np.concatenate([np.asarray(embedder.vectors(texts[k : k + batch]), np.float32) for k in range(0, len(texts), batch)]) if texts else np.zeros((0, embedder.dim), np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * embedder.dim), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), lists], names=[*kept, name])

    said = F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit("")))
    return rows.select(*[F.col(f"`{c}`") for c in kept], said.alias("_embedded_text")).sortWithinPartitions(F.char_length("_embedded_text")).mapInArrow(run, f"{kinds}, `{name}` array<float>")


def profile(config: dict, name: str | None = None) -> dict:
    """The named profile of {default, profiles: {name: {backend, model, ...}}}, or the default one."""
    chosen = name or config.get("default")
    found = config.get("profiles", {}).get(chosen)
    if found is None:
        raise ValueError(f"no embedder profile is called {chosen!r}")
    if "backend" not in found:
        raise ValueError(f"the profile {chosen!r} names no backend")
    return {"name": chosen, **found}


def normalized(v: Column) -> Column:
    """Length one; zero vectors stay zero."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))
