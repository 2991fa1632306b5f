"""MinHash verification and exact duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES, SHINGLE = 128, 5
#: Lanes a band holds: at 0.8, a pair misses all 21 bands in two of a thousand cases.
ROWS, BANDS = 6, 21
PRIME = (1 << 61) - 1
_SEED = 0x5EED


def normalized(text: str) -> Column:
    """Lower case; runs of punctuation and white space become one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.col(text)), r"[\p{Punct}\s]+", " "))


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finish."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def _product(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a * x modulo PRIME, both below it, by halves of 31 bits."""
    low, half = np.uint64((1 << 31) - 1), np.uint64(31)
    a1, a0, x1, x0 = a >> half, a & low, x >> half, x & low
    mid = a1 * x0 + a0 * x1
    return _reduced(np.uint64(2) * (a1 * x1) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << half) + a0 * x0)


def coefficients(lanes: int = LANES, seed: int = _SEED) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of each lane's a * x + b modulo PRIME, by SplitMix64 from the seed; no a is zero."""
    step = np.uint64(seed) + np.arange(1, 2 * lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = _mixed(step) % np.uint64(PRIME)
    return np.maximum(x[:lanes], np.uint64(1)), x[lanes:]


#: Bytes of text whose shingles are hashed together; a longer text is one by itself.
SLICE = 4_000_000
_SPACE = 32
_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[[*range(9, 14), *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _SPACE


def _normalized(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """normalized() of lower-cased texts that lie end to end, as bytes; their ends. A space at a text's end stays."""
    x = _NORMAL[x]
    space = x == _SPACE
    first = np.zeros(len(x) + 1, bool)
    first[ends] = first[0] = True
    kept = ~space
    kept[1:] |= space[1:] & ~space[:-1]
    kept &= ~(space & first[:-1])
    return x[kept], np.concatenate([[0], np.cumsum(kept)])[ends]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def _signed(x: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A row of lanes a text of lower-cased texts that lie end to end. Shingles that texts share are hashed once, and one lane is held at a time."""
    out, found, which = np.zeros((len(ends), len(a)), np.int64), [], []
    x, ends = _normalized(x, ends)
    x = x.astype(np.uint64)
    codes = sum(x[k : max(0, len(x) - SHINGLE + 1) + k] << np.uint64(8 * k) for k in range(SHINGLE))
    for i, (start, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
        end -= end > start and x[end - 1] == _SPACE
        if end - start >= SHINGLE:
            found.append(_distinct(codes[start : end - SHINGLE + 1]))
            which.append(i)
    if not which:
        return out
    every, first = np.concatenate(found), np.cumsum([0, *map(len, found[:-1])])
    one = _distinct(every)
    place, h = np.searchsorted(one, every), _reduced(_mixed(one) >> np.uint64(2))
    for lane in range(len(a)):
        out[which, lane] = np.minimum.reduceat(_reduced(_product(a[lane], h) + b[lane]).astype(np.int64)[place], first)
    return out


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, sig): minima of LANES linear hashes over the SHINGLE-byte shingles of the normalized text; zeros for shorter texts."""
    a, b = coefficients()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            at = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
            k = 0
            while k < len(data):
                to = max(k + 1, int(np.searchsorted(at, at[k] + SLICE, "right")) - 1)
                x = np.frombuffer(data.buffers()[2], np.uint8)[at[k] : at[to]] if at[to] > at[k] else np.zeros(0, np.uint8)
                sig = _signed(x, at[k + 1 : to + 1] - at[k], a, b)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(to - k + 1, dtype=np.int32) * LANES), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, to - k), lists], names=["doc_id", "sig"])
                k = to

    return docs.select("doc_id", F.lower(text).alias("t")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, sig array<long>")


def jaccard(a: str, b: str) -> Column:
    """Share of equal lanes."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x) / {LANES}D")


def near(queries: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """(query_id, doc_id, jaccard) of signatures at or above the threshold. Pairs meet in a band of equal lanes; texts without a shingle meet nobody.

    A band's hash is the key, so rows of one text have one key each: they are told apart after signatures are made distinct,
    and a hot key holds different texts only.
    """
    some = F.exists("sig", lambda x: x != 0)
    keys = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, slice(sig, i * {ROWS} + 1, {ROWS})))")
    told = lambda s: s.where(some).withColumn("s", F.struct(F.xxhash64("sig").alias("a"), F.xxhash64(F.lit(1), "sig").alias("b")))
    q, r = told(queries), told(rows)
    one = lambda x: x.groupBy("s").agg(F.first("sig").alias("sig"))
    deal = lambda x, n: x.select(F.col("s").alias(n), F.explode(keys).alias("k"))
    pairs = deal(one(q), "p").join(deal(one(r), "t"), "k").select("p", "t").distinct()
    j = pairs.join(one(q).select(F.col("s").alias("p"), F.col("sig").alias("u")), "p").join(one(r).select(F.col("s").alias("t"), F.col("sig").alias("v")), "t")
    ok = j.withColumn("jaccard", jaccard("u", "v")).where(F.col("jaccard") >= threshold).select("p", "t", "jaccard")
    j = ok.join(q.select(F.col("s").alias("p"), F.col("doc_id").alias("query_id")), "p").join(r.select(F.col("s").alias("t"), "doc_id"), "t")
    return j.select("query_id", "doc_id", "jaccard")


def verify(pairs: DataFrame, a: str, b: str, threshold: float) -> DataFrame:
    return pairs.where(jaccard(a, b) >= threshold)


def exact_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(content_hash, first_id, copies) of texts that occur more than once."""
    return docs.groupBy(F.sha2(text, 256).alias("content_hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
