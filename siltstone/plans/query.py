"""One plan for a table of queries: filter, dense or hybrid retrieval, reranking, decay, hits with their rows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import filters, temporal
from ..operators import retrieval

# Seconds of each unit of a duration.
UNITS = {"s": 1, "sec": 1, "m": 60, "min": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400, "w": 604800, "week": 604800, "month": 2630016, "y": 31557600, "year": 31557600}


def days(text: str) -> float:
    """Days of a duration such as 30d, 1y or '2 weeks 3 days'."""
    parts = re.findall(r"\s*(\d+)\s*([a-z]+)\s*", text)
    units = [u if u in UNITS else u.removesuffix("s") for _, u in parts]
    if not parts or "".join(f"{n}{u}" for n, u in parts) != re.sub(r"\s+", "", text) or any(u not in UNITS for u in units):
        raise ValueError(f"not a duration: {text!r}")
    return sum(int(n) * UNITS[u] for (n, _), u in zip(parts, units)) / 86400


@dataclass(frozen=True)
class Decay:
    fields: tuple[str, ...]
    halflife: float = 30.0
    weight: float = 0.3
    prior: float = 0.5
    blend: str = "multiplicative"


@dataclass(frozen=True)
class Hybrid:
    """Both retrievers to k * overfetch, fused by ranks."""

    on: bool = False
    rrf_k: int = 60
    overfetch: int = 4
    decay: Decay | None = None


def hybrid_options(hybrid: bool = False, rrf_k: int = 60, overfetch: int = 4, decay_field: str | None = None, halflife: str = "30d", weight: float = 0.3, prior: float = 0.5, blend: str = "multiplicative") -> Hybrid:
    """Options from flat values. Settings of decay without a field for it, an unknown blend and a bad duration are errors; decay turns hybrid search on."""
    if decay_field is None and (halflife != "30d" or weight != 0.3 or prior != 0.5):
        raise ValueError("half-life, weight and prior of the decay need a date field")
    if blend not in ("multiplicative", "additive"):
        raise ValueError(f"the blend is multiplicative or additive, not {blend!r}")
    decay = None if decay_field is None else Decay(tuple(f.strip() for f in decay_field.split(",")), days(halflife), weight, prior, blend)
    return Hybrid(hybrid or decay is not None, rrf_k, overfetch, decay)


def hybrid_top_k(queries: DataFrame, chunks: DataFrame, k: int, options: Hybrid = Hybrid(on=True), stems: bool = True) -> DataFrame:
    """(query_id, id, score, rank) of queries(query_id, text, q) over chunks(id, text, v)."""
    pool = k * options.overfetch
    words = retrieval.bm25(queries.select("query_id", "text"), chunks.select("id", "text"), pool, stems=stems).select("query_id", "id", "rank")
    dense = retrieval.dense_top_k(queries.select("query_id", "q"), chunks.select("id", "v"), pool).select("query_id", "id", "rank")
    return retrieval.rrf([words, dense], options.rrf_k, k)


def decayed(hits: DataFrame, decay: Decay, now: str) -> DataFrame:
    """hits(query_id, id, score, ...) with the decay in their score; ranks are not renewed."""
    date = temporal.extract_date(*[F.col(f) for f in decay.fields])
    if decay.blend == "additive":
        return temporal.additive(hits, date, now, decay.halflife, 1 - decay.weight, decay.prior)
    return hits.withColumn("score", F.col("score") * temporal.factor(date, now, decay.halflife, decay.weight, decay.prior))


@dataclass(frozen=True)
class Request:
    """What is asked of a corpus: how many hits, a filter, retrieval, reranking, the policy of recency."""

    k: int = 5
    condition: object = None
    hybrid: Hybrid = field(default_factory=Hybrid)
    rerank: bool = False
    rerank_overfetch: int = 10
    policy: str | None = None
    now: str = "2024-02-01"
    cwe_field: str | None = None


def run(queries: DataFrame, chunks: DataFrame, request: Request, closure: dict[int, list[int]] | None = None, reranker=retrieval.overlap) -> DataFrame:
    """(query_id, id, score, rank) of queries(query_id, text, q[, weaknesses]) over chunks(id, text, v, ...fields).

    The filter, rewritten by the taxonomy where the corpus names a weakness field, is applied before retrieval: results are
    exact and never short. Reranking scores a larger pool anew, then decay is applied, to the pool, and the best k are ranked.
    """
    rows = chunks
    if request.condition is not None:
        tree = filters.parse(request.condition) if isinstance(request.condition, str) else request.condition
        rows = filters.apply(rows, filters.expand(tree, request.cwe_field, closure or {}) if request.cwe_field else tree)
    pool = request.k * (request.rerank_overfetch if request.rerank else 1)
    hits = hybrid_top_k(queries, rows, pool, request.hybrid) if request.hybrid.on else retrieval.dense_top_k(queries.select("query_id", "q"), rows.select("id", "v"), pool)
    hits = hits.select("query_id", "id", "score")
    late = request.rerank or request.hybrid.decay or request.policy
    if late:
        fields = [c for c in rows.columns if c not in ("v", "score", "query_id", "rank")]
        hits = hits.join(rows.select(*fields), "id")
    if request.rerank:
        hits = hits.join(queries.select("query_id", F.col("text").alias("_asked")), "query_id").withColumn("score", reranker("_asked", "text"))
    if request.hybrid.decay:
        hits = decayed(hits, request.hybrid.decay, request.now)
    if request.policy:
        asked = queries.select("query_id", temporal.resolved(F.lit(request.policy), temporal.policy(F.col("text"))).alias("_policy"))
        date = temporal.extract_date(*[F.col(f) for f in (request.hybrid.decay.fields if request.hybrid.decay else ("published_date",)) if f in hits.columns] or [F.lit(None).cast("date")])
        hits = temporal.by_policy(hits.join(asked, "query_id"), date, request.now, "_policy")
    return retrieval.top_k(hits.select("query_id", "id", "score"), request.k)


def run_batch(queries: DataFrame, chunks: DataFrame, conditions: dict[str, object] | None = None, k: int = 5) -> tuple[DataFrame, dict[str, str]]:
    """(hits, errors) of queries(query_id, q[, k, filter]), each with its own k and the name of its filter.

    `filter` names one of `conditions` (few: a plan each); a condition that can't be parsed is an error of its queries alone.
    """
    conditions, errors, parts = conditions or {}, {}, []
    has_k, has_filter = "k" in queries.columns, "filter" in queries.columns
    most = (queries.agg(F.max("k")).first()[0] or k) if has_k else k
    for name in [None, *conditions] if has_filter else [None]:
        mine = queries if not has_filter else queries.where(F.col("filter").isNull() if name is None else F.col("filter") == name)
        try:
            rows = chunks if name is None else filters.apply(chunks, conditions[name])
        except filters.FilterError as e:
            errors[name] = str(e)
            continue
        hits = retrieval.dense_top_k(mine.select("query_id", "q"), rows.select("id", "v"), most)
        if has_k:
            hits = hits.join(mine.select("query_id", F.coalesce("k", F.lit(k)).alias("_k")), "query_id").where(F.col("rank") <= F.col("_k")).drop("_k")
        parts.append(hits.select("query_id", "id", "score", "rank"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, errors


def with_weaknesses(condition, text: str, field_: str, closure: dict[int, list[int]]):
    """A request's filter and the one that weakness ids in its text ask for, both rewritten by the taxonomy."""
    own = filters.from_ids(text, field_, closure)
    given = None if condition is None else filters.expand(filters.parse(condition) if isinstance(condition, str) else condition, field_, closure)
    return given if own is None else own if given is None else filters.Bool("AND", (own, given))


def cross_encoded(hits: DataFrame, score: Column) -> DataFrame:
    """hits with a model's score put through the logistic function; the model is any vectorized column, none is bundled."""
    return hits.withColumn("score", 1 / (1 + F.exp(-score)))
