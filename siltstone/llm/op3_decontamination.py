"""Benchmark decontamination with suffix arrays over the training documents.

Documents are cut into shards of a few megabytes within their partition (a document is never split, nothing is shuffled).
A shard's words become numbers of the benchmark's vocabulary, and the suffixes that begin with a benchmark word are sorted:
by their first words at once, and by the words behind them in the ranges that a benchmark suffix reaches. Every suffix of
every benchmark item is then searched by bisection, block of words by block of words, which gives the range (all
locations) of its window and its longest verbatim match. Words are matched by 64-bit hashes (benchmark words that share one are
told apart by their letters) and each word that is hit is compared letter by letter.

The benchmark travels to the executors in blocks of a fixed size, one in a worker's memory at a time, so it may be larger
than that size. Null or empty text: no words, not contaminated. Null or empty item: no window. An item without an id
counts as hit words but not among the items; an id on several rows is one item. Repeated documents: a row each. Empty
tables: empty result, or nobody contaminated. Extra columns are passed through untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, table

WINDOW = 10
SHARD_BYTES = 4_000_000
BLOCK_WORDS = 500_000
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_BYTE = np.array([(b + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for b in range(256)], np.uint64)
_P = 0xD6E8FEB86659FD93
_INV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, min(1 << n.bit_length(), SHARD_BYTES + (1 << 16)))  # a shard's in workers; the driver needs a few for the benchmark's words
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.full(size - 1, m, np.uint64)]).cumprod(dtype=np.uint64) for m in (_P, _INV)]
    return _powers[0][:n], _powers[1][:n]


def words_of(low: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of lower-cased text."""
    a = np.frombuffer(low, np.uint8)
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = _IS_WORD[a]
    edge = np.flatnonzero(np.diff(w, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    up, down = _power(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[:-1], out=sums[1:])
    return start, end, (sums[end] - sums[start]) * down[start]


class Block:
    """Some benchmark items: vocabulary, and every suffix of each item as vocabulary numbers (1 and up)."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        texts = [_WORDS.findall(t) for _, t in items]
        vocabulary = sorted({w for t in texts for w in t})
        joined = b" ".join(vocabulary)
        hashes = words_of(joined)[2]
        order = np.argsort(hashes)
        self.hashes, self.words = hashes[order], [vocabulary[i] for i in order]
        number = {w: i + 1 for i, w in enumerate(self.words)}
        # words that share a hash are told apart by their letters
        shared = np.unique(self.hashes[1:][self.hashes[1:] == self.hashes[:-1]])
        self.shared = {int(h): {self.words[i]: i + 1 for i in np.flatnonzero(self.hashes == h).tolist()} for h in shared}
        self.items, self.window = [i for i, _ in items], window
        bits = max(1, int(len(self.words)).bit_length())
        self.bits, self.per = bits, max(1, min(16, 63 // bits))
        ids = [np.array([number[w] for w in t], np.int64) for t in texts]
        lens = np.array([len(x) for x in ids], np.int64)
        self.flat = np.concatenate([*ids, np.zeros(self.per, np.int64)])
        base = np.cumsum(lens) - lens
        self.item = np.repeat(np.arange(len(ids)), lens)  # a suffix each
        self.at = np.arange(int(lens.sum()))
        self.left = np.repeat(base + lens, lens) - self.at  # words to the item's end
        size = np.minimum(window, lens)
        self.size = np.repeat(size, lens)  # of the item's windows

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """Of each position: the next `per` words in one number. ids end in `per` zeros."""
        n = len(ids) - self.per
        key = np.zeros(n, np.uint64)
        for k in range(self.per):
            key = (key << np.uint64(self.bits)) | ids[k : k + n].astype(np.uint64)
        return key

    def search(self, key: np.ndarray, query: np.ndarray, length: np.ndarray, side_lo=None) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the sorted keys whose first `length` words (at most `per`) are the query's."""
        free = ((self.per - np.minimum(length, self.per)) * self.bits).astype(np.uint64)
        low = (query >> free) << free
        return np.searchsorted(key, low, "left"), np.searchsorted(key, low + (np.uint64(1) << free) - np.uint64(1), "right")


def _scan(block: Block, start, end, hashes, doc_of, low: bytes):
    """Hit word intervals (position, length), their items, and the longest match from each position of a shard."""
    at = np.searchsorted(block.hashes, hashes)
    at[at == len(block.hashes)] = 0
    ids = np.where(block.hashes[at] == hashes, at + 1, 0)
    if block.shared:
        for i in np.flatnonzero(np.isin(hashes, np.array(list(block.shared), np.uint64))).tolist():
            ids[i] = block.shared[int(hashes[i])].get(low[start[i] : end[i]], 0)
    ids = np.concatenate([ids, np.zeros(block.per, np.int64)])
    # a document's last word is followed by another document's first: keep them apart by a gap
    gap = np.flatnonzero(np.diff(doc_of)) + 1
    shift = np.zeros(len(doc_of), np.int64)
    shift[gap] = 1
    place = np.arange(len(doc_of)) + np.cumsum(shift)
    spread = np.zeros(len(doc_of) + len(gap) + block.per, np.int64)
    spread[place] = ids[: len(doc_of)]
    word_at = np.full(len(spread), -1, np.int64)
    word_at[place] = np.arange(len(doc_of))
    key = block.keys(spread)
    suffixes = np.flatnonzero(spread[: len(key)])
    suffixes = suffixes[np.argsort(key[suffixes], kind="stable")]
    ranked = key[suffixes]
    query = block.keys(block.flat)
    lo, hi = block.search(ranked, query, np.minimum(block.left, block.size))
    pos, size, item, longest = [], [], [], []
    for s in np.flatnonzero(hi > lo):
        n, w, begin = int(block.left[s]), int(block.size[s]), int(block.at[s])
        found, depth = suffixes[lo[s] : hi[s]], min(block.per, w, n)
        want = w if n >= w else n
        while depth < want and len(found):  # the next words, sorted and bisected
            step = min(block.per, want - depth)
            inside = found + depth
            inside = np.where(inside < len(key), inside, len(key) - 1)
            k = key[inside]
            order = np.argsort(k, kind="stable")
            a, b = block.search(k[order], query[begin + depth : begin + depth + 1], np.array([step]))
            found, depth = found[order[a[0] : b[0]]], depth + step
        if n < w or not len(found):
            continue
        far, reach = found, want  # on to the longest match
        while reach < n:
            inside = far + reach
            ok = inside < len(spread)
            far2 = far[ok][spread[inside[ok]] == block.flat[begin + reach]]
            if not len(far2):
                break
            far, reach = far2, reach + 1
        pos.append(found)
        size.append(np.full(len(found), w))
        item.append(np.full(len(found), block.item[s]))
        best = np.full(len(found), w)
        best[np.isin(found, far)] = reach
        longest.append(best)
    if not pos:
        return None
    pos, size, item, longest = word_at[np.concatenate(pos)], np.concatenate(size), np.concatenate(item), np.concatenate(longest)
    # letter by letter: hit words are the vocabulary's words
    cover = np.zeros(len(doc_of) + 1, np.int64)
    np.add.at(cover, pos, 1)
    np.add.at(cover, pos + size, -1)
    hit = np.flatnonzero(np.cumsum(cover)[:-1])
    wrong = np.array([i for i in hit.tolist() if low[start[i] : end[i]] != block.words[ids[i] - 1]], np.int64)
    if len(wrong):
        good = np.searchsorted(wrong, pos) == np.searchsorted(wrong, pos + size)
        pos, size, item, longest = pos[good], size[good], item[good], longest[good]
    return pos, size, item, longest


def _shard(blocks, texts: list[str]) -> list[tuple]:
    """(n_words, n_hit, items, spans, longest) of each text."""
    low = [t.encode().translate(_LOW) for t in texts]
    joined = b"\n".join(low)
    start, end, hashes = words_of(joined)
    offsets = np.cumsum([0, *[len(b) + 1 for b in low]])
    doc_of = np.searchsorted(offsets, start, "right") - 1
    n_words = np.bincount(doc_of, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    cover = np.zeros(len(start) + 1, np.int64)
    items: list[set] = [set() for _ in texts]
    hit_docs: set[int] = set()
    longest = np.zeros(len(texts), np.int64)
    if len(start):
        for holder in blocks:
            block = holder.value
            if (x := _scan(block, start, end, hashes, doc_of, joined)) is not None:
                np.add.at(cover, x[0], 1)
                np.add.at(cover, x[0] + x[1], -1)
                d = doc_of[x[0]]
                np.maximum.at(longest, d, x[3])
                for i in np.unique(d * len(block.items) + x[2]).tolist():
                    hit_docs.add(i // len(block.items))
                    if (name := block.items[i % len(block.items)]) is not None:
                        items[i // len(block.items)].add(name)
            if len(blocks) > 1:
                holder.__dict__.pop("_value", None)
    hit = np.cumsum(cover)[:-1] > 0
    out = []
    for i in range(len(texts)):
        spans = []
        if i in hit_docs:
            edge = np.flatnonzero(np.diff(hit[first[i] : first[i] + n_words[i]], prepend=False, append=False)).tolist()
            spans = [{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2])]
        out.append((int(n_words[i]), sum(s["end"] - s["start"] for s in spans), sorted(items[i]), spans, int(longest[i])))
    return out


RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))), T.StructField("longest", T.LongType())])
_RESULT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("longest", pa.int64())])


def locate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or keep) and a struct `_match`: n_words, n_hit, items, spans (runs of hit words), longest (words of the longest verbatim match)."""
    spark = docs.sparkSession
    blocks, items, size = [], [], 0
    for r in benchmark.select(F.col(item_id).cast("string"), F.coalesce(F.col(text), F.lit(""))).toLocalIterator():
        t = r[1].encode().translate(_LOW)
        items.append((r[0], t))
        size += len(_WORDS.findall(t))
        if size >= BLOCK_WORDS:
            blocks.append(spark.sparkContext.broadcast(Block(items, window)))
            items, size = [], 0
    if size:
        blocks.append(spark.sparkContext.broadcast(Block(items, window)))
    keep = docs.columns if keep is None else keep
    at = "_words_of"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, sizes = 0, np.array(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
            texts = batch.column(batch.num_columns - 2)
            while begin < batch.num_rows:
                stop = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), SHARD_BYTES)))
                part = batch.slice(begin, stop - begin)
                found = [dict(zip(("n_words", "n_hit", "items", "spans", "longest"), x)) for x in _shard(blocks, texts.slice(begin, stop - begin).to_pylist())]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], pa.array(found, _RESULT)], names=[*keep, "_match"])
                begin = stop
        release()

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("_match", RESULT)])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias(at), F.octet_length(F.coalesce(F.col(text), F.lit(""))).alias(at + "_n")).mapInArrow(run, schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark window, with all their columns."""
    return locate(docs, benchmark).where("_match.n_hit = 0").drop("_match")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = locate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    m = F.col("_match")
    return found.select("doc_id", m["n_words"].alias("n_words"), m["n_hit"].alias("n_hit"), F.size(m["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(m["items"], ","), 256).alias("items_sha256"), (m["n_hit"] > 0).alias("contaminated"))


def sql(documents: str = "documents") -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, {words} AS w FROM {documents}),
b AS (SELECT item_id, {words} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, w[k : k + least({WINDOW}, len(w)) - 1] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
g AS (SELECT row_no, k, n, w[k : k + n - 1] AS g FROM (SELECT row_no, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
m AS (SELECT row_no, k, i.n, item_id FROM g JOIN i ON g.n = i.n AND g.g = i.g),
h AS (SELECT row_no, count(DISTINCT p) AS n_hit FROM (SELECT row_no, unnest(range(k, k + n)) AS p FROM m) GROUP BY row_no),
t AS (SELECT row_no, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT row_no, CAST(item_id AS VARCHAR) AS x FROM m WHERE item_id IS NOT NULL) GROUP BY row_no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row_no) LEFT JOIN t USING (row_no)"""
