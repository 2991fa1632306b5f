"""Document scores by masked pseudo-likelihood.

Every token is predicted from the SPAN tokens on either side of it by a small window network, and a document's score is
the sum of the log-probabilities. The network's tokens are the most frequent words, counted over all documents, and buckets
for the others. The output is a two-level softmax (32 classes of 32 tokens), so a prediction costs 64 outputs, not 1024. The
network is trained in numpy over all documents: each partition makes one pass from the same start (biases from the counts), the
averaged network, weighted by tokens, is what scores.

A word in a bucket has the bucket's probability times its share of the bucket's count over all documents. Every word that
occurs RARE times or more has its own share; the rarer ones of a bucket, and one unseen word, divide theirs evenly, so the
probabilities of all words have the sum 1. The network has a fixed size; the table of shares grows with the corpus: up to
SENT words it is sent to the executors, beyond that the words of the documents are joined to it by their hashes, counted by
document first. Both give the same scores.

Words: lower-cased A-Z, digits, and any byte from 0x80. Null, empty or wordless text: no tokens, score 0, mean null.
Repeated rows: one row each. Very long texts: whole. Empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table
from .op3_decontamination import _LOW, words_of

SPAN, DIM, SIDE = 2, 16, 32
VOCABULARY, BUCKETS = SIDE * SIDE, 256
WORDS = VOCABULARY - BUCKETS - 1  # token 0 is what lies outside a document
BATCH, RATE, SHARD_BYTES = 4096, 0.15, 2_000_000
SHAPES = {"e": (2 * SPAN, VOCABULARY, DIM), "b": (DIM,), "c": (DIM, SIDE), "cb": (SIDE,), "w": (SIDE, DIM, SIDE), "wb": (SIDE, SIDE)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())
BLOCK = 4096
RARE = 20
#: Most words whose shares are sent to every executor (16 bytes each in a worker).
SENT = 4_000_000


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        out[k] = flat[at : at + int(np.prod(s))].reshape(s)
        at += int(np.prod(s))
    return out


def start(counts: np.ndarray) -> np.ndarray:
    """The network before training: small random tables, biases from the tokens' counts."""
    flat = np.random.default_rng(7).normal(0, 0.1, SIZE).astype(np.float32)
    net = unpack(flat)
    p = (counts + 1.0) / (counts + 1.0).sum()
    p = p.reshape(SIDE, SIDE)
    net["b"][:] = 0
    net["cb"][:] = np.log(p.sum(1))
    net["wb"][:] = np.log(p / p.sum(1, keepdims=True))
    return flat


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % BUCKETS


def tokens(texts: list[str], hashes: np.ndarray, number: np.ndarray, share: np.ndarray | None = None, rare: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(padded tokens, places of the words, words of each text, logs of the words' shares in their tokens); documents lie SPAN outside tokens apart."""
    low = [t.encode().translate(_LOW) for t in texts]
    s, _, h = words_of(b"\n".join(low))
    offsets = np.cumsum([0, *[len(b) + 1 for b in low]])
    doc = np.searchsorted(offsets, s, "right") - 1
    bucket = bucket_of(h)
    ids, own = 1 + WORDS + bucket, None if rare is None else rare[bucket]
    if len(hashes):
        at = np.searchsorted(hashes, h)
        at[at == len(hashes)] = 0
        found = hashes[at] == h
        ids = np.where(found, number[at], ids)
        if own is not None:
            own = np.where(found, share[at], own)
    place = np.arange(len(s)) + SPAN * (doc + 1)
    padded = np.zeros(len(s) + SPAN * (len(texts) + 1), np.int64)
    padded[place] = ids
    return padded, place, np.bincount(doc, minlength=len(texts)), own


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


_OFFSETS = [o for o in range(-SPAN, SPAN + 1) if o]


def step(net: dict, padded: np.ndarray, place: np.ndarray, rate: float | None) -> np.ndarray:
    """Log-probabilities of the tokens at place; with a rate, a descent step too."""
    y = padded[place]
    order = np.argsort((y // SIDE).astype(np.int8), kind="stable")
    place, y = place[order], y[order]
    around = [padded[place + o] for o in _OFFSETS]
    h = net["b"] + sum(net["e"][k][c] for k, c in enumerate(around))
    np.tanh(h, out=h)
    cls, sub = y // SIDE, y % SIDE
    rows = np.arange(len(y))
    p = _softmax(h @ net["c"] + net["cb"])
    logp = np.log(p[rows, cls] + 1e-30)
    edges = np.searchsorted(cls, np.arange(SIDE + 1))
    if rate is not None:
        p[rows, cls] -= 1
        dh = p @ net["c"].T
        scale = rate / len(y)
        gc, gcb = h.T @ p, p.sum(0)
    for k in range(SIDE):
        a, b = edges[k], edges[k + 1]
        if a == b:
            continue
        hk, r = h[a:b], np.arange(b - a)
        q = _softmax(hk @ net["w"][k] + net["wb"][k])
        logp[a:b] += np.log(q[r, sub[a:b]] + 1e-30)
        if rate is not None:
            q[r, sub[a:b]] -= 1
            dh[a:b] += q @ net["w"][k].T
            net["w"][k] -= scale * SIDE * 0.25 * (hk.T @ q)
            net["wb"][k] -= scale * SIDE * 0.25 * q.sum(0)
    if rate is not None:
        net["c"] -= scale * 4 * gc
        net["cb"] -= scale * 4 * gcb
        dh *= 1 - h * h
        net["b"] -= scale * dh.sum(0)
        for k, c in enumerate(around):
            for d in range(DIM):
                net["e"][k][:, d] -= scale * 40 * np.bincount(c, dh[:, d], VOCABULARY).astype(np.float32)
    out = np.empty(len(y))
    out[order] = logp
    return out


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    sizes = np.cumsum(np.array(batch.column(column + 1).to_numpy(zero_copy_only=False)))
    at, done = 0, 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(sizes, done + SHARD_BYTES, "right")))
        yield at, batch.column(column).slice(at, stop - at).to_pylist()
        done, at = sizes[stop - 1], stop


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, n): every word of all documents."""
    words = docs.select(F.explode(F.split(ascii_lower(F.col("text")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")).alias("w")).where("w <> ''")
    return cut(words.groupBy("w").agg(F.count("*").alias("n")))


def _hashed(counted: DataFrame, words: list[str]) -> DataFrame:
    """(bucket, h, n) of the counted words other than `words`."""
    top = _lookup(words)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = words_of("\n".join(b.column(0).to_pylist()).encode())[2]
            other = ~np.isin(h, top)
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(h)[other], pa.int64()), pa.array(h.view(np.int64)[other], pa.int64()), b.column(1).filter(pa.array(other))], names=["bucket", "h", "n"])

    return counted.select("w", "n").mapInArrow(run, "bucket long, h long, n long")


def bucket_counts(counted: DataFrame, words: list[str]) -> np.ndarray:
    """By bucket: the count of its words, of those below RARE, and how many words are below it."""
    rare = F.col("n") < RARE
    out = np.zeros((BUCKETS, 3))
    for r in _hashed(counted, words).groupBy("bucket").agg(F.sum("n").alias("a"), F.sum(F.when(rare, F.col("n")).otherwise(0)).alias("b"), F.count_if(rare).alias("c")).collect():
        out[r.bucket] = r.a, r.b, r.c
    return out


def _vocabulary(counted: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    top = counted.orderBy(F.desc("n"), "w").limit(WORDS).collect()
    words = [r.w for r in top]
    buckets = bucket_counts(counted, words)
    counts = np.zeros(VOCABULARY)
    counts[1 : 1 + len(top)] = [r.n for r in top]
    counts[1 + WORDS :] = buckets[:, 0]
    return words, counts, buckets


def vocabulary(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The most frequent words over all documents, and the count of each token; both of a fixed size."""
    return _vocabulary(word_counts(docs))[:2]


def shares(counted: DataFrame, words: list[str], buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, logs of the shares) of the words that occur RARE times or more, without `words`; by bucket, the log of the share of any other word."""
    t = _hashed(counted.where(F.col("n") >= RARE), words).toArrow()
    h = t.column("h").to_numpy().view(np.uint64)
    share = np.log(t.column("n").to_numpy() / (buckets[bucket_of(h), 0] + 1))
    return h, share.astype(np.float32), np.log((buckets[:, 1] + 1) / ((buckets[:, 2] + 1) * (buckets[:, 0] + 1))).astype(np.float32)


def train(docs: DataFrame, words: list[str], counts: np.ndarray) -> np.ndarray:
    """The averaged network: each partition's pass over its documents, weighted by its tokens."""
    spark = docs.sparkSession
    hashes, number = _lookup(words)
    first = start(counts)
    sent = spark.sparkContext.broadcast((hashes, number, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number, first = sent.value
        flat, seen = first.copy(), 0
        net = unpack(flat)
        for batch in batches:
            for _, texts in _slices(batch, 0):
                padded, place, _, _ = tokens(texts, hashes, number)
                for k in range(0, len(place), BATCH):
                    step(net, padded, place[k : k + BATCH], RATE / (1 + seen / 4e6))
                    seen += len(place[k : k + BATCH])
        if seen:
            blocks = [flat[k : k + BLOCK].tolist() for k in range(0, SIZE, BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([seen] * len(blocks), pa.int64()), pa.array(blocks, pa.list_(pa.float32()))], names=["block", "n", "v"])

    parts = _texts(docs).select("t", "b").mapInArrow(run, "block int, n long, v array<float>")
    # a grouped sum a weight: no task holds the networks of all partitions
    each = parts.select("block", "n", F.posexplode("v").alias("i", "x"))
    mean = each.groupBy("block", "i").agg((F.sum(F.col("x").cast("double") * F.col("n")) / F.sum("n")).cast("float").alias("x"))
    found = mean.toArrow()  # SIZE rows
    if not found.num_rows:
        return first
    out = np.empty(SIZE, np.float32)
    out[found.column("block").to_numpy().astype(np.int64) * BLOCK + found.column("i").to_numpy()] = found.column("x").to_numpy()
    return out


def _lookup(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words_of(" ".join(words).encode())[2]
    order = np.argsort(h)
    return h[order], order + 1


def _texts(docs: DataFrame, *keep: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return docs.select(*keep, t.alias("t"), F.octet_length(t).alias("b"))


def _own_shares(docs: DataFrame, counted: DataFrame, words: list[str], buckets: np.ndarray, rare: np.ndarray) -> DataFrame:
    """(doc_id, th, more): by how much the own shares of a document's words exceed the even share of their buckets' rare words, summed."""
    top = _lookup(words)[0]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in _slices(b, 2):
                low = [t.encode().translate(_LOW) for t in texts]
                s, _, h = words_of(b"\n".join(low))
                doc = np.searchsorted(np.cumsum([0, *[len(x) + 1 for x in low]]), s, "right") - 1
                other = ~np.isin(h, top)
                pair = np.rec.fromarrays([doc[other], h[other]], names="d,h")
                found, n = np.unique(pair, return_counts=True)
                take = pa.array(found["d"].astype(np.int64) + at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.ascontiguousarray(found["h"]).view(np.int64)), pa.array(n.astype(np.int64))], names=["doc_id", "th", "h", "c"])

    said = _texts(docs, "doc_id", "th").select("doc_id", "th", "t", "b").mapInArrow(run, f"doc_id {kind}, th long, h long, c long")
    sizes = docs.sparkSession.createDataFrame([(i, float(np.log(b[0] + 1)), float(r)) for i, (b, r) in enumerate(zip(buckets, rare))], "bucket long, total double, even double")  # BUCKETS rows
    own = _hashed(counted.where(F.col("n") >= RARE), words).join(F.broadcast(sizes), "bucket").select("h", (F.log("n") - F.col("total") - F.col("even")).alias("more"))
    return said.join(own, "h").groupBy("doc_id", "th").agg(F.sum(F.col("c") * F.col("more")).alias("more"))


def score(docs: DataFrame, words: list[str], network: np.ndarray, doc_id: str = "doc_id", share: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob); without `share`, what shares() returns, a word counts as its bucket."""
    hashes, number = _lookup(words)
    own, rare = np.zeros(len(hashes), np.float32), None
    if share is not None:
        more, logs, rare = share
        order = np.argsort(all_ := np.concatenate([hashes, more]))
        hashes, number, own = all_[order], np.concatenate([number, 1 + WORDS + bucket_of(more)])[order], np.concatenate([own, logs])[order]
    sent = docs.sparkSession.sparkContext.broadcast((hashes, number.astype(np.int16), own, rare, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number, own, rare, flat = sent.value
        net = unpack(flat)
        for batch in batches:
            counts, sums = [], []
            for _, texts in _slices(batch, 1):
                padded, place, n, in_token = tokens(texts, hashes, number, own, rare)
                logp = np.concatenate([np.zeros(1), *[step(net, padded, place[k : k + BATCH], None) for k in range(0, len(place), BATCH)]])
                if in_token is not None:
                    logp[1:] += in_token
                logp = logp.cumsum()
                ends = np.cumsum(n)
                counts += n.tolist()
                sums += (logp[ends] - logp[ends - n]).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.float64())], names=["doc_id", "n_tokens", "log_prob"])

    kind = docs.schema[doc_id].dataType.simpleString()
    out = _texts(docs.withColumnRenamed(doc_id, "doc_id"), "doc_id").mapInArrow(run, f"doc_id {kind}, n_tokens long, log_prob double")
    return out.withColumn("mean_log_prob", F.expr("try_divide(log_prob, n_tokens)"))


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    counted = word_counts(docs)
    words, counts, buckets = _vocabulary(counted)
    network = train(docs, words, counts)
    if counted.where(F.col("n") >= RARE).count() <= SENT:
        return score(docs, words, network, share=shares(counted, words, buckets))
    rare = np.log((buckets[:, 1] + 1) / ((buckets[:, 2] + 1) * (buckets[:, 0] + 1))).astype(np.float32)
    d = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    base = score(d.select(F.struct("doc_id", "th").alias("doc_id"), "text"), words, network, share=(np.zeros(0, np.uint64), np.zeros(0, np.float32), rare))
    base = base.select("doc_id.doc_id", "doc_id.th", "n_tokens", "log_prob")
    # rows of one id and text are counted together, so their sum is shared out
    more = cut(_own_shares(d, counted, words, buckets, rare).join(d.groupBy("doc_id", "th").agg(F.count("*").alias("k")).select(F.col("doc_id").alias("_i"), F.col("th").alias("_t"), "k"), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("th") == F.col("_t"))).select("_i", "_t", (F.col("more") / F.col("k")).alias("more")))
    j = base.join(more, base.doc_id.eqNullSafe(more["_i"]) & (base.th == more["_t"]), "left")
    return j.select("doc_id", "n_tokens", (F.col("log_prob") + F.coalesce("more", F.lit(0.0))).alias("log_prob")).withColumn("mean_log_prob", F.expr("try_divide(log_prob, n_tokens)"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))
