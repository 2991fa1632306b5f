"""SimHash near-duplicates with pivot distance tables.

Fingerprints: the majority of each bit over the XXH64 hashes of a document's 3-word shingles; hashing is built in, the bit
sums are numpy over Arrow batches. Only distinct fingerprints go on, each with its smallest document id.

Candidates: two fingerprints within 3 bits agree wholly on one of four 16-bit bands, where their distances to every
reference are equal; such buckets are dealt over the cluster. A bucket above BUCKET rows is split again: the bits that are
not yet known to agree form four new bands, one of which must agree too. After six splits 12 bits or fewer are open, so no
bucket can hold more than a few thousand distinct fingerprints, however skewed the input. Within buckets the pivot table
(distances to PIVOTS reference fingerprints) discards every pair that differs by more than 3 in some coordinate; the
survivors are verified by their exact distance. A bucket returns a spanning forest of its links, never all pairs.

Null, empty or blank text: fingerprint zero, linked like any other. A null doc_id gets the smallest id of its
component, null if no row there has one. Repeated rows: a row each. Empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, components, cut, release, table

RADIUS, PIVOTS, BUCKET = 3, 32, 1024


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, by the SplitMix64 rule."""
    x = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(0x1234567)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Hashes whose bits are unpacked at a time, 64 bytes each.
UNPACKED = 50_000


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(1)
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        ends = np.cumsum(sizes)
        out, at = np.zeros(b.num_rows, np.uint64), 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + UNPACKED)))
            n = sizes[at:stop]
            part = lists.slice(at, stop - at).flatten().to_numpy(zero_copy_only=False)
            full = n > 0
            if full.any():
                ones = np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                firsts = (np.cumsum(n) - n)[full]
                sums = np.add.reduceat(ones, firsts, axis=0, dtype=np.int64)
                major = np.packbits(sums * 2 > n[full][:, None], axis=1, bitorder="little")
                out[at:stop][full] = np.ascontiguousarray(major).view(np.uint64).ravel()
            at = stop
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64), pa.int64())], names=["doc_id", "fp"])
    release()


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long."""
    words = F.expr(r"array_remove(split(_t, '[\\x20\\x09-\\x0D]+'), '')")
    d = docs.select(F.col(doc_id).alias("doc_id"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("_t")).select("doc_id", words.alias("w"))
    h = F.expr("CASE WHEN size(w) = 0 THEN array() WHEN size(w) < 3 THEN array(xxhash64(array_join(w, ' '))) ELSE transform(sequence(0, size(w) - 3), i -> xxhash64(concat_ws(' ', w[i], w[i + 1], w[i + 2]))) END")
    kind = docs.schema[doc_id].dataType.simpleString()
    return d.select("doc_id", h.alias("h")).mapInArrow(_bits, f"doc_id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def submasks(mask: int) -> list[int]:
    """Four parts of the bits that mask leaves open, each with mask's own bits."""
    free = [i for i in range(64) if not mask >> i & 1]
    k = RADIUS + 1
    return [mask | sum(1 << i for i in free[len(free) * j // k : len(free) * (j + 1) // k]) for j in range(k)]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (m, v, fp, node) sorted by m, v: spanning forests of the links of each bucket."""
    refs = pivots()
    rest: tuple = (np.zeros(0, np.int64),) * 4

    def forest(cols) -> pa.RecordBatch:
        m, v, fp, node = cols
        n = len(m)
        new = np.ones(n, bool)
        new[1:] = (m[1:] != m[:-1]) | (v[1:] != v[:-1])
        firsts = np.flatnonzero(new)
        sizes = np.diff(np.append(firsts, n))
        left = np.repeat(firsts + sizes, sizes) - np.arange(n) - 1  # rows behind in the bucket
        u = fp.view(np.uint64)
        table_ = np.bitwise_count(u[:, None] ^ refs[None, :]).astype(np.int8)
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = p
            return x

        live, d, out = np.flatnonzero(left >= 1), 1, []
        while len(live):
            i, j = live, live + d
            for p in range(PIVOTS):
                ok = np.abs(table_[i, p] - table_[j, p]) <= RADIUS
                i, j = i[ok], j[ok]
            ok = np.bitwise_count(u[i] ^ u[j]) <= RADIUS
            for a, b in zip(node[i[ok]].tolist(), node[j[ok]].tolist()):
                ra, rb = find(a), find(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
                    out.append((a, b))
            d += 1
            live = live[left[live] >= d]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for b in batches:
        cols = [np.concatenate([r, b.column(i).to_numpy(zero_copy_only=False)]) for i, r in enumerate(rest)]
        m, v = cols[0], cols[1]
        last = np.flatnonzero((m != m[-1]) | (v != v[-1])) if len(m) else np.zeros(0, int)
        stop = int(last[-1]) + 1 if len(last) else 0
        if stop:
            yield forest([c[:stop] for c in cols])
        rest = tuple(c[stop:] for c in cols)
    if len(rest[0]):
        yield forest(rest)


def links(fps: DataFrame) -> DataFrame:
    """fps(fp, node) with distinct fp: (a, b), enough links to connect all that are connected within RADIUS bits."""
    spark = fps.sparkSession
    masks = submasks(0)
    deal = lambda df, of: df.select("fp", "node", F.explode(of).alias("m")).withColumn("v", F.col("fp").bitwiseAND(F.col("m")))
    rows, parts = deal(fps, F.array(*[F.lit(_signed(x)) for x in masks])), []
    for _ in range(7):
        sizes = rows.groupBy("m", "v").agg(F.count("*").alias("n")).where("n > 1")
        sizes = cut(sizes)
        parts.append(rows.join(sizes.where(F.col("n") <= BUCKET), ["m", "v"], "left_semi"))
        hot = sizes.where(F.col("n") > BUCKET)
        if not hot.limit(1).count():
            break
        # four rows a mask, 16,384 at the last split
        finer = F.broadcast(spark.createDataFrame([(_signed(x), [_signed(y) for y in submasks(x)]) for x in masks], "m long, f array<long>"))
        rows = deal(rows.join(hot, ["m", "v"], "left_semi").join(finer, "m").select("fp", "node", "f"), F.col("f"))
        masks = sorted({y for x in masks for y in submasks(x)})
    else:
        parts.append(rows.join(sizes, ["m", "v"], "left_semi"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = None
    for p in parts:
        found = p.select("m", "v", "fp", "node").repartition(n, "m", "v").sortWithinPartitions("m", "v").mapInArrow(_links, "a long, b long")
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links; ids of any ordered type."""
    found = cut(fingerprints(docs, text, doc_id))
    fps = cut(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(fps.select("fp", F.col("fp").alias("node"))))
    linked = cut(fps.join(roots, fps.fp == roots.node).select("fp", "root", "first"))  # a table whose size is known, so that it is broadcast where it may be
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of = fps.join(linked.join(least, "root").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return found.join(of, "fp").select("doc_id", "fp", "component_id")


def _keep_rows(docs: DataFrame) -> DataFrame:
    """One row of each component, where ids are repeated or null: rows are told apart by id and text, rows with an id come first."""
    # a row is told apart by its text's digest: two 64-bit hashes
    text = F.coalesce("text", F.lit(""))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b")).alias("_k"))
    found = cut(fingerprints(d, "text", "_k").distinct())
    roots = components(links(found.select("fp", F.col("fp").alias("node")).distinct()))
    of = found.join(roots, found.fp == roots.node, "left").select(F.col("doc_id").alias("_k"), F.coalesce("root", "fp").alias("_root"))
    first = d.select("doc_id", "_k").join(of, "_k").groupBy("_root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_k")).alias("x"))
    first = first.select(F.col("x.doc_id").alias("_id"), F.col("x._k").alias("_of"))
    kept = d.join(first, d["_k"].eqNullSafe(first["_of"]) & d["doc_id"].eqNullSafe(first["_id"]), "left_semi")
    return kept.dropDuplicates(["_k"]).select("_row.*")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, the one with the smallest doc_id (a null one last), with all its columns."""
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count():
        return _keep_rows(docs)
    gone = near_duplicates(docs.select("doc_id", "text")).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"))
    return rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
