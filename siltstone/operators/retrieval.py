"""Search: exact vector top-k, an index of cells, BM25, rank fusion, reranking, thresholds, snippets.

Every search takes a table of queries in one plan. Vectors are multiplied in Arrow batches, a block of queries at a time, and
only what a query may still need leaves a batch.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stem
from ..functions.embed import normalized

#: Queries that are sent to all executors at a time; more are run block after block.
BLOCK = 4096


def dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x AS double) * cast(y AS double)), 0D, (s, x) -> s + x)")


def cosine(a: str, b: str) -> Column:
    """0 where a norm is zero or the lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def normalize(v: str) -> Column:
    """Length one; zero vectors stay zero. For writing: searches need no norm of such vectors."""
    return normalized(F.col(v))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of length one; zeros for a null, a zero vector and one of another length."""
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dim))
    ok = np.flatnonzero(sizes == dim)
    flat = lists.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False)
    out[ok] = np.nan_to_num(flat.astype(np.float64)).reshape(len(ok), dim)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


#: Products that a worker holds at a time, and what rounding to 12 places may add to one.
CELLS, SLACK = 1 << 20, 1e-12


def _codes(asked: pa.Array, mine: pa.Array, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of both sides' values, equal where the values are; NaN equals nothing."""
    if not known:
        known.update({x: i for i, x in enumerate(dict.fromkeys(asked.to_pylist()))})
    of = lambda values, other: np.array([known.get(x, other) if x == x else other for x in values.to_pylist()], np.int64)
    return of(asked, -1), of(mine, -2)


class _Best:
    """The k best rows of each query so far, ties to the smaller id. New rows are gathered and merged when they are as many as those that are kept."""

    def __init__(self, n: int, k: int, names: list[str]) -> None:
        self.n, self.k, self.names, self.held, self.more, self.low = n, k, names, None, [], np.full(n, -np.inf)

    def add(self, j: np.ndarray, score: np.ndarray, rows: list[pa.Array]) -> None:
        self.more.append(pa.Table.from_arrays([pa.array(j), pa.array(score), *rows], names=self.names))
        if sum(map(len, self.more)) >= max(self.n * self.k, 1 << 16):
            self.merge()

    def merge(self) -> pa.Table | None:
        if not self.more:
            return self.held
        t = pa.concat_tables([*([] if self.held is None else [self.held]), *self.more]).combine_chunks()
        kind = t.schema.field("r:id").type if "r:id" in t.schema.names else pa.null()
        told = pa.types.is_integer(kind) or pa.types.is_string(kind)  # other ids: all ties stay
        t = t.take(pc.sort_indices(t, [("j", "ascending"), ("score", "descending"), *([("r:id", "ascending")] if told else [])], null_placement="at_start"))
        j, v = t.column("j").to_numpy(), t.column("score").to_numpy()
        rank = np.arange(len(j)) - np.searchsorted(j, j)
        last = rank == self.k - 1
        self.low[j[last]] = v[last]
        self.held, self.more = t.filter(pa.array(rank < self.k if told else (rank < self.k) | (v >= self.low[j]))), []
        return self.held


def scored(queries: DataFrame, rows: DataFrame, k: int | None = None, threshold: float | None = None, same: tuple[str, str] | None = None, differ: tuple[str, str] | None = None) -> DataFrame:
    """Pairs of queries(query_id, q, ...) and rows(id, v, ...) with their cosine as `score`, all other columns kept.

    With k, a query's k best of each task (ties to the smaller id); with a threshold, what reaches it; `same` and
    `differ` name a column of the queries and one of the rows that must agree, or must not. With neither, every pair: for
    sums over them, as the pairs grow with queries times rows. Unequal lengths and zero vectors score 0. A worker holds CELLS
    products and its queries' k best rows, however many rows a task has.
    """
    spark, left, right = queries.sparkSession, [c for c in queries.columns if c != "q"], [c for c in rows.columns if c != "v"]
    kinds = [(c, queries.schema[c].dataType) for c in left] + [(c, rows.schema[c].dataType) for c in right]
    schema = ", ".join(f"`{c}` {t.simpleString()}" for c, t in kinds) + ", score double"
    n, out = max(1, math.ceil(queries.count() / BLOCK)), None
    for b in range(n):
        part = queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b)
        asked = part.select(*left, "q").toArrow().combine_chunks()
        lengths = [x for x in asked.column("q").combine_chunks().value_lengths().to_pylist() if x]
        dim = max(lengths, default=0)
        sent = spark.sparkContext.broadcast((asked.drop_columns(["q"]), _matrix(asked.column("q").combine_chunks(), dim)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, dim=dim) -> Iterator[pa.RecordBatch]:
            asked, q = sent.value
            pair = lambda j, v, rows: pa.RecordBatch.from_arrays([*(asked.column(c).combine_chunks().take(pa.array(j)) for c in left), *rows, pa.array(v)], names=[*left, *right, "score"])
            best = None if k is None else _Best(len(q), k, ["j", "score", *(f"r:{c}" for c in right)])
            told = [(names, agree, {}) for names, agree in ((same, True), (differ, False)) if names]
            step = max(1, CELLS // max(1, len(q)))
            for whole in batches:
                for at in range(0, whole.num_rows if len(q) and k != 0 else 0, step):
                    batch = whole.slice(at, step)
                    s = _matrix(batch.column(batch.num_columns - 1), dim) @ q.T
                    least = np.full(len(q), -np.inf if threshold is None else threshold)
                    if best is not None:
                        np.maximum(least, best.low, out=least)
                    ok = s >= least - SLACK
                    for names, agree, known in told:
                        theirs, mine = _codes(asked.column(names[0]), batch.column(right.index(names[1])), known)
                        ok &= (mine[:, None] == theirs[None, :]) == agree
                    if best is not None and len(s) > k and np.count_nonzero(ok) > 4 * k * len(q):
                        s[~ok] = -np.inf
                        ok &= s >= -np.partition(-s, k - 1, axis=0)[k - 1] - SLACK
                    i, j = np.nonzero(ok)
                    v = np.round(s[i, j], 12)
                    ok = v >= least[j]
                    i, j, v = i[ok], j[ok], v[ok]
                    found = [batch.column(x).take(pa.array(i)) for x in range(len(right))]
                    if best is None:
                        yield pair(j, v, found)
                    else:
                        best.add(j, v, found)
            held = best and best.merge()
            for part in held.combine_chunks().to_batches(max_chunksize=1 << 16) if held is not None else []:
                yield pair(part.column(0).to_numpy(), part.column(1).to_numpy(), part.columns[2:])

        pairs = rows.select(*right, "v").mapInArrow(run, schema)
        out = pairs if out is None else out.unionByName(pairs)
    return out


def top_k(pairs: DataFrame, k: int, by: str = "query_id", id_: str = "id") -> DataFrame:
    """The k best of each query, ties to the smaller id. The window's group limit prunes before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), F.asc(id_)))
    return pairs.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def dense_top_k(queries: DataFrame, rows: DataFrame, k: int, **how) -> DataFrame:
    return top_k(scored(queries, rows, k=k, **how), k)


# --- an index of cells

#: Rows that centres are fitted to, and rounds of fitting. The sample is the rows with the smallest hashed ids.
FIT_ROWS, FIT_ROUNDS = 20_000, 12


def fit_cells(rows: DataFrame, cells: int, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Centres of k-means on the directions of a bounded sample of rows(id, v)."""
    n = rows.count()
    share = min(1.0, 1.5 * fit_rows / max(n, 1) + 0.001)
    near = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("id")).limit(fit_rows).select("v").toArrow()
    lists = near.column("v").combine_chunks()
    x = _matrix(lists, max(lists.value_lengths().to_pylist(), default=0))
    rng = np.random.default_rng(3)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)] if len(x) else np.zeros((0, 0))
    for _ in range(FIT_ROUNDS):
        of = (x @ centres.T).argmax(1) if len(centres) else np.zeros(0, int)
        for c in range(len(centres)):
            if (m := x[of == c]).size and (norm := np.linalg.norm(m.sum(0))) > 0:
                centres[c] = m.sum(0) / norm
    return centres


def in_cells(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Every row with the cell of its nearest centre. Written partitioned by cell, a search reads the cells it probes only."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = (_matrix(b.column(b.num_columns - 1), sent.value.shape[1]) @ sent.value.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), pa.array(c.astype(np.int32))], names=[*b.schema.names, "cell"])

    cols = [*[c for c in rows.columns if c != "v"], "v"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in cols)
    return rows.select(*cols).mapInArrow(run, f"{kinds}, cell int")


def cell_top_k(queries: DataFrame, indexed: DataFrame, centres: np.ndarray, k: int, probes: int) -> DataFrame:
    """top_k of the rows in the `probes` cells nearest to each query; approximate, and its recall grows with probes."""
    spark, out = queries.sparkSession, None
    n = max(1, math.ceil(queries.count() / BLOCK))
    rows = [c for c in indexed.columns if c not in ("v", "cell")]
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, " + ", ".join(f"`{c}` {indexed.schema[c].dataType.simpleString()}" for c in rows) + ", score double"
    for b in range(n):
        part = queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b)
        asked = part.select("query_id", "q").toArrow().combine_chunks()
        q = _matrix(asked.column("q").combine_chunks(), centres.shape[1])
        near = np.argsort(-(q @ centres.T), axis=1)[:, :probes]
        by = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
        sent = spark.sparkContext.broadcast((asked.column("query_id").combine_chunks(), q, by))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q, by = sent.value
            for batch in batches:
                cell = batch.column(batch.num_columns - 1).to_numpy()
                v = _matrix(batch.column(batch.num_columns - 2), q.shape[1])
                for c in np.unique(cell).tolist():
                    i, j = np.flatnonzero(cell == c), by.get(c, np.zeros(0, int))
                    if not len(j):
                        continue
                    s = np.round(v[i] @ q[j].T, 12)
                    ok = s >= -np.partition(-s, k - 1, axis=0)[k - 1] if len(i) > k else np.ones(s.shape, bool)
                    x, y = np.nonzero(ok)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(j[y])), *(batch.column(r).take(pa.array(i[x])) for r in range(len(rows))), pa.array(s[x, y])], names=["query_id", *rows, "score"])

        found = indexed.where(F.col("cell").isin([int(c) for c in by])).select(*rows, "v", "cell").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return top_k(out, k)


# --- text


def tokens(text: str) -> Column:
    return F.expr(f"filter(split(lower({text}), '[^a-z0-9]+'), x -> x <> '')")


def analyzed(text: str, stems: bool) -> Column:
    """Tokens, with stems of English words in their place."""
    return stem.stemmed(tokens(text)) if stems else tokens(text)


#: Query terms that are sent to all executors.
FEW = 100_000


def bm25(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, stems: bool = False) -> DataFrame:
    """queries(query_id, text), docs(id, text): top k by BM25 over exact lengths, OR of the distinct query terms.

    Document frequency and length are grouped sums; only postings of query terms are joined. With stems, those of the
    documents' different words are told, not of each word of each text.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(analyzed("text", stems))).alias("term"))
    words = docs.select("id", tokens("text").alias("t"))
    stats = words.agg(F.count("*").alias("n_docs"), F.avg(F.size("t")).alias("avg_len"))
    every, wanted = words.select("id", F.size("t").alias("len"), F.explode("t").alias("word")), terms.select("term").distinct()
    few = F.broadcast if wanted.count() <= FEW else lambda x: x  # else the words of all texts are sorted for the join
    if stems:
        known = every.select("word").distinct().select("word", stem.stem_of(F.col("word")).alias("term")).join(few(wanted), "term", "left_semi")
        # the words of a wanted stem are its few endings
        posted = every.join(few(known), "word")
    else:
        posted = every.withColumnRenamed("word", "term").join(few(wanted), "term", "left_semi")
    posted = posted.groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    j = terms.join(df, "term").join(posted, "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return top_k(j.groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score")), k)


def rrf(lists: list[DataFrame], k: int, top: int) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, rank) lists, ranks from 1: sum of 1 / (k + rank)."""
    every = lists[0].select("query_id", "id", "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("query_id", "id", "rank"))
    return top_k(every.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score")), top)


def overlap(query: str, text: str) -> Column:
    """Query tokens (repeats count) that are substrings of the text, both lower-cased."""
    return F.expr(f"size(filter(filter(split(lower({query}), '\\\\s+'), x -> x <> ''), x -> contains(lower({text}), x)))").cast("double")


def rerank(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """hits(query_id, id, ...) scored anew, the k best kept."""
    return top_k(hits.drop("rank").withColumn("score", score), k)


def above(queries: DataFrame, rows: DataFrame, threshold: float, top: int | None = None) -> DataFrame:
    """All pairs at or above the threshold, or each query's best `top` of them."""
    pairs = scored(queries, rows, k=top, threshold=threshold)
    return pairs if top is None else top_k(pairs, top)


def highlighted(query: Column, text: Column, n: int) -> Column:
    """The stretch of at most n characters that holds most different query words (then most of them, then the first), by stems, as escaped HTML with them in bold; null without any."""

    @F.pandas_udf("string")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for q, t in zip(queries, texts):
            wanted = {stem.stem(w.lower()) for w in re.findall("[A-Za-z0-9]+", q or "")}
            hits = [(m.start(), m.end(), s) for m in re.finditer("[A-Za-z0-9]+", t or "") if (s := stem.stem(m[0].lower())) in wanted]
            best, first = None, 0
            for last in range(len(hits)):
                while first < last and hits[last][1] - hits[first][0] > n:
                    first += 1
                key = (len({h[2] for h in hits[first : last + 1]}), last - first, -hits[first][0])
                if best is None or key > best[0]:
                    best = (key, first, last)
            out.append(None if best is None else _fragment(t, hits[best[1] : best[2] + 1], n))
        return pd.Series(out)

    return run(query, text)


def _fragment(text: str, hits: list[tuple[int, int, str]], n: int) -> str:
    """The text about the hits, widened to whole words up to n characters."""
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    a, b = hits[0][0], hits[-1][1]
    inside = [w for w in words if w[1] > a and w[0] < b]
    low, high = words.index(inside[0]), words.index(inside[-1])
    if words[high][1] - words[low][0] > n:
        start, stop = a, min(b, a + n)
    else:
        while high + 1 < len(words) and words[high + 1][1] - words[low][0] <= n:
            high += 1
        while low and words[high][1] - words[low - 1][0] <= n:
            low -= 1
        start, stop = words[low][0], words[high][1]
    safe = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    out, at = [], start
    for x, y, _ in hits:
        if y <= stop:
            out += [safe(text[at:x]), "<b>", safe(text[x:y]), "</b>"]
            at = y
    return "".join([*out, safe(text[at:stop])])


def snippet(text: str, n: int) -> Column:
    """The text if it has at most n characters, else its first n cut at the last space, with an ellipsis."""
    return F.when(F.char_length(text) <= n, F.col(text)).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, n), r" [^ ]*$", ""), F.lit("...")))


def identifiers(text: str) -> Column:
    """CVE ids, then CWE ids, upper-cased."""
    return F.expr(f"transform(concat(regexp_extract_all({text}, '(?i)\\\\b(CVE-[0-9]{{4}}-[0-9]{{4,}})\\\\b', 1), regexp_extract_all({text}, '(?i)\\\\b(CWE-[0-9]+)\\\\b', 1)), x -> upper(x))")
