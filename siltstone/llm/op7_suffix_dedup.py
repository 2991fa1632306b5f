"""Removal of repeated 200-byte strings by sharded induced suffix sorting.

Shards: each 200-byte window has an anchor, its least-hashed K-gram, which depends on nothing but the window, so equal
windows have equal anchors at equal places. Consecutive windows with one anchor form a segment; segments of one anchor are
one group of a shard. Only anchors that occur in two different segments need sorting; a segment that occurs twice whole is
repeated throughout.

Sorting: the suffixes of a group's segments are induced from right to left. The order at a place is the order at the place
behind it, stably dealt by the byte before, and the common prefix of two neighbours is one more than the least common
prefix between them one place on. The tuples (group, byte, rank, common prefix) of many groups are carried together.
Groups reach the task through Spark's external sort, which spills to disk, and a batch of groups is all that is held.
A group above GROUP segments is not gathered: its windows are counted by their digests over the whole cluster. Segments,
and the windows of such a group, are told apart by anchor and digest (64 bits of BLAKE2 each).

external_induction.py has the form with disk-backed queues and recursion; the README has what it costs, and why it is not
the one that runs.

Null text: empty. Texts shorter than the window: nothing removed. Matches never cross documents. Repeated rows: each is
the other's copy. Rows with the same id and text give the same result. Empty table: empty result. Extra columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, release, table

WINDOW, GRAM = 200, 32
GROUP = 20_000
SHARD_BYTES = 3_000_000
PIECE = 1 << 18  # windows whose anchors are looked for together
ROWS = 20_000  # segments sorted together
FETCHED = 5_000  # segments sent on together
_PLACE = np.uint64((1 << 31) - 1)  # no text is longer
_M = 0x9E3779B97F4A7C15
_P = 0xD6E8FEB86659FD93
_INV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + WINDOW)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.full(size - 1, m, np.uint64)]).cumprod(dtype=np.uint64) for m in (_P, _INV)]
    return _powers[0][:n], _powers[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _anchors(cat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each window's anchor, and the hashes of the grams."""
    n = len(cat)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((cat.astype(np.uint64) + np.uint64(1)) * np.uint64(_M) * up[:-1], out=sums[1:])
    gram = _mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    low = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    width, have = WINDOW - GRAM + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    return (low & _PLACE).astype(np.int64), gram


def segment(texts: list[bytes]):
    """Segments of some documents: document, first window, windows, anchor's place (in the document), anchor.

    PIECE windows at a time, whatever the length of a text; a segment goes on from one piece to the next.
    """
    cat = np.frombuffer(b"".join(texts), np.uint8)
    lens = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(lens)
    total = len(cat) - WINDOW + 1
    if not (lens >= WINDOW).any():
        return None
    before, found = -1, []  # (place, anchor's place or -1, anchor) where the anchor changes; -1: the window crosses documents
    for lo in range(0, total, PIECE):
        hi = min(lo + PIECE, total)
        at, gram = _anchors(cat[lo : hi + WINDOW - 1])
        at += lo
        for e in end[np.searchsorted(end, lo, "right") : np.searchsorted(end, hi + WINDOW)].tolist():
            at[max(e - WINDOW + 1 - lo, 0) : max(e - lo, 0)] = -1
        new = np.flatnonzero(np.diff(at, prepend=before))
        place = at[new]
        found.append((new + lo, place, np.where(place < 0, np.uint64(0), gram[np.maximum(place - lo, 0)])))
        before = int(at[-1])
    first, place, anchor = (np.concatenate(x) for x in zip(*found))
    count = np.diff(np.append(first, total))
    inside = place >= 0
    first, place, anchor, count = first[inside], place[inside], anchor[inside], count[inside]
    of = np.searchsorted(end, first, "right")
    base = (end - lens)[of]
    return of, first - base, count, place - base, anchor.view(np.int64)


def digest(content: bytes) -> int:
    """Of a segment's bytes: unlike the rolling hash that finds anchors, not one that two texts can be made to share."""
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True)


def _parts(batch: pa.RecordBatch, column: int):
    """(begin, texts) of slices of about SHARD_BYTES."""
    sizes = np.cumsum([len(x) if x else 0 for x in (v.as_buffer() if v.is_valid else None for v in batch.column(column))]) if batch.num_rows else np.zeros(0)
    at, done = 0, 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(sizes, done + SHARD_BYTES, "right")))
        yield at, [x or b"" for x in batch.column(column).slice(at, stop - at).to_pylist()]
        done, at = sizes[stop - 1], stop


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, bytes) -> (doc_id, th, idx, anchor, sh) of each segment."""
    for b in batches:
        for at, texts in _parts(b, 2):
            if (s := segment(texts)) is not None:
                of, begin, count, place, anchor = s
                take = pa.array(of + at)
                idx = np.arange(len(of)) - np.searchsorted(of, of)
                ends = begin + count - 1 + WINDOW
                content = np.frombuffer(b"".join([hashlib.blake2b(texts[d][a:e], digest_size=8).digest() for d, a, e in zip(of.tolist(), begin.tolist(), ends.tolist())]), "<i8")
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(idx.astype(np.int32)), pa.array(anchor), pa.array(content)], names=["doc_id", "th", "idx", "anchor", "sh"])
    release()


def _nested(column: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """Of a column of lists of structs: where each row's structs begin and end, and the structs' fields."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.append(0, np.cumsum(sizes, dtype=np.int64)), column.flatten().flatten()


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(need list of (idx, n, hot), bytes) -> the needed segments' bytes."""
    for b in batches:
        for at, texts in _parts(b, 1):
            if (s := segment(texts)) is None:
                continue
            of, begin, count, place, anchor = s
            edge, (idx, n, hot) = _nested(b.column(0).slice(at, len(texts)))
            doc = np.repeat(np.arange(len(texts)), np.diff(edge))
            j = np.searchsorted(of, doc) + idx.to_numpy()
            a, e = begin[j], begin[j] + count[j] - 1 + WINDOW
            for k in range(0, len(j), FETCHED):
                here = slice(k, k + FETCHED)
                content = [texts[d][x:y] for d, x, y in zip(doc[here].tolist(), a[here].tolist(), e[here].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[j[here]]), pa.array([digest(c) for c in content], pa.int64()), pa.array((place[j[here]] - a[here]).astype(np.int32)), pa.array(content, pa.binary()), n.slice(k, FETCHED), hot.slice(k, FETCHED)], names=["anchor", "sh", "lead", "bytes", "n", "hot"])
    release()


def induce(group: np.ndarray, lead: np.ndarray, strings: list[bytes], window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Repeated windows of aligned strings: (row, first byte in the row) of each window that starts at or before the aligned place and equals another of its group.

    group: numbers in order; lead: the aligned place in each string. Suffixes are induced place by place from the right.
    """
    m = len(strings)
    left = int(lead.max())
    sizes = np.array([len(s) for s in strings])
    width = left + int((sizes - lead).max())
    grid = np.zeros((width, m), np.int16)
    for r in range(0, m, 1_000):
        n = sizes[r : r + 1_000]
        flat = np.frombuffer(b"".join(strings[r : r + 1_000]), np.uint8)
        row = np.repeat(np.arange(len(n)), n)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n - (left - lead[r : r + 1_000]), n)
        grid[col, r + row] = flat.astype(np.int16) + 1
    first, last = left - lead, left - lead + sizes - window  # windows start in between
    order, prefix = np.arange(m), np.zeros(m, np.int64)
    for at in range(width - 1, -1, -1):
        key = (group[order] << 9) | grid[at][order]
        turn = np.argsort(key, kind="stable")
        if m > 1:
            k = key[turn]
            same = (k[1:] == k[:-1]) & ((k[1:] & 511) > 0)
            p, q = turn[:-1][same], turn[1:][same]
            new = np.zeros(m, np.int64)
            if len(p):
                edges = np.empty(2 * len(p), np.int64)
                edges[::2], edges[1::2] = p + 1, q + 1
                new[np.flatnonzero(same) + 1] = 1 + np.minimum.reduceat(np.append(prefix, 0), edges)[::2]
            order, prefix = order[turn], new
            if at <= left:
                long = prefix >= window
                twice = long.copy()
                twice[:-1] |= long[1:]
                rows = order[twice]
                rows = rows[(first[rows] <= at) & (at <= last[rows])]
                if len(rows):
                    yield rows, at - first[rows]


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by anchor -> (anchor, sh, offs) of once-occurring segments with repeated windows."""
    held: list = []
    count = 0

    def flush(cols) -> Iterator[pa.RecordBatch]:
        anchor, sh, lead, strings, n = cols
        new = np.ones(len(anchor), np.int64)
        new[1:] = anchor[1:] != anchor[:-1]
        hit = np.zeros((len(anchor), int(lead.max()) + 1), bool)
        for rows, offs in induce(np.cumsum(new), lead, strings):
            hit[rows, offs] = True
        hit[n != 1] = False
        some = np.flatnonzero(hit.any(axis=1))
        for k in range(0, len(some), FETCHED):
            at = some[k : k + FETCHED]
            rows, offs = np.nonzero(hit[at])
            starts = np.searchsorted(rows, np.arange(len(at) + 1))
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(offs.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(anchor[at]), pa.array(sh[at]), lists], names=["anchor", "sh", "offs"])

    def columns(bs):
        t = pa.Table.from_batches(bs)
        return [t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy().astype(np.int64), t.column(3).to_pylist(), t.column(4).to_numpy()]

    for b in batches:
        held.append(b)
        count += b.num_rows
        if count >= ROWS:
            cols = columns(held)
            last = np.flatnonzero(cols[0] != cols[0][-1])
            stop = int(last[-1]) + 1 if len(last) else 0
            if stop:
                yield from flush([c[:stop] for c in cols])
            del cols
            held = [pa.Table.from_batches(held).slice(stop).combine_chunks().to_batches()[0]]
            count = held[0].num_rows
    if count:
        yield from flush(columns(held))
    held.clear()
    release()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of hot anchors -> a row a window: (anchor, sh, off, wh, n), wh being a 64-bit digest of the window."""
    for b in batches:
        for r in range(0, b.num_rows, 500):
            part = b.slice(r, 500)
            anchor, sh, n = (part.column(i).to_numpy() for i in (0, 1, 4))
            strings = part.column(3).to_pylist()
            w = np.array([len(s) for s in strings]) - WINDOW + 1
            row = np.repeat(np.arange(len(strings)), w)
            off = np.arange(len(row)) - np.repeat(np.cumsum(w) - w, w)
            wh = np.frombuffer(b"".join([hashlib.blake2b(s[k : k + WINDOW], digest_size=8).digest() for s in strings for k in range(len(s) - WINDOW + 1)]), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(anchor[row]), pa.array(sh[row]), pa.array(off.astype(np.int32)), pa.array(wh), pa.array(n[row])], names=["anchor", "sh", "off", "wh", "n"])
    release()


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, list of (idx, whole, offs), bytes) -> the result rows and the removed spans."""
    for b in batches:
        for at, texts in _parts(b, 2):
            edge, (idx, whole, offs) = _nested(b.column(1).slice(at, len(texts)))
            some = np.flatnonzero(np.diff(edge))
            sizes, removed, digests, starts, ends = [len(t) for t in texts], [0] * len(texts), [], [], []
            bound = np.zeros(len(texts) + 1, np.int32)
            if len(some):
                of, begin, count, _, _ = segment([texts[i] for i in some])
                # a mark is one span of a whole segment, or a window at each of its places
                j = np.searchsorted(of, np.repeat(np.arange(len(some)), np.diff(edge)[some])) + idx.to_numpy()
                whole, cuts, places = whole.to_numpy(zero_copy_only=False), offs.offsets.to_numpy(), offs.values.to_numpy()
            for i, t in enumerate(texts):
                kept, done = hashlib.sha256(), 0
                if (a := int(edge[i])) < (z := int(edge[i + 1])):
                    w = np.flatnonzero(whole[a:z]) + a
                    first = begin[j[a:z]]
                    lo = np.concatenate([begin[j[w]], places[cuts[a] : cuts[z]] + np.repeat(first, np.diff(cuts[a : z + 1]))])
                    hi = np.concatenate([begin[j[w]] + count[j[w]] - 1, lo[len(w) :]]) + WINDOW
                    order = np.argsort(lo)
                    lo, hi = lo[order], np.maximum.accumulate(hi[order])
                    new = np.flatnonzero(lo[1:] > hi[:-1]) + 1
                    lo, hi = lo[np.append(0, new)].tolist(), hi[np.append(new - 1, len(hi) - 1)].tolist()
                    for x, y in zip(lo, hi):
                        kept.update(t[done:x])
                        done = y
                    removed[i] = sum(hi) - sum(lo)
                    starts += lo
                    ends += hi
                kept.update(t[done:])
                digests.append(kept.hexdigest())
                bound[i + 1] = len(starts)
            spans = pa.ListArray.from_arrays(pa.array(bound), pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["start", "end"]))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(np.diff(bound).astype(np.int64)), pa.array(digests, pa.string()), spans], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
    release()


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): spans are the removed byte runs."""
    kind = docs.schema[doc_id].dataType.simpleString()
    bytes_ = F.coalesce(F.col(text), F.lit("")).cast("binary")
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), bytes_.alias("bytes"))
    rows = cut(d.mapInArrow(_emit, f"doc_id {kind}, th long, idx int, anchor long, sh long"))
    distinct = cut(rows.groupBy("anchor", "sh").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "idx")).alias("rep")))
    several = distinct.groupBy("anchor").agg(F.count("*").alias("d")).where("d > 1")
    need = distinct.join(several, "anchor").select("rep.doc_id", "rep.th", F.struct(F.col("rep.idx").alias("idx"), "n", (F.col("d") > GROUP).alias("hot")).alias("x")).groupBy("doc_id", "th").agg(F.collect_list("x").alias("need"))
    n2 = need.select(F.col("doc_id").alias("i"), F.col("th").alias("t"), "need")
    fetched = d.join(n2, d.doc_id.eqNullSafe(n2.i) & (d.th == n2.t)).select("need", "bytes").mapInArrow(_fetch, "anchor long, sh long, lead int, bytes binary, n long, hot boolean")
    fetched = cut(fetched)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = fetched.where("NOT hot").drop("hot").repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_groups, "anchor long, sh long, offs array<int>")
    marks = plain
    if fetched.where("hot").limit(1).count():
        w = fetched.where("hot").drop("hot").mapInArrow(_windows, "anchor long, sh long, off int, wh long, n long")
        twice = w.groupBy("anchor", "wh").agg(F.sum("n").alias("c")).where("c > 1").drop("c")
        marks = marks.unionByName(w.where("n = 1").join(twice, ["anchor", "wh"], "left_semi").groupBy("anchor", "sh").agg(F.collect_list("off").alias("offs")))
    whole = distinct.where("n > 1").select("anchor", "sh", F.lit(True).alias("whole"), F.array().cast("array<int>").alias("offs"))
    marks = cut(whole.unionByName(marks.select("anchor", "sh", F.lit(False).alias("whole"), "offs")))
    drop(fetched)
    drop(distinct)
    of = rows.join(marks, ["anchor", "sh"]).groupBy("doc_id", "th").agg(F.collect_list(F.struct("idx", "whole", "offs")).alias("marks"))
    of = of.select(F.col("doc_id").alias("i"), F.col("th").alias("t"), "marks")
    done = d.join(of, d.doc_id.eqNullSafe(of.i) & (d.th == of.t), "left").select("doc_id", "marks", "bytes")
    return done.mapInArrow(_finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("spans")
