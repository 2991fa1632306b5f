"""Retrieval metrics, gold sets, buckets, matrices of variants, baselines and gates, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judged(ranked: DataFrame, qrels: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(totals, hits) of ranked(query_id, id, rank), qrels(query_id, id, rel > 0): the number of relevant rows of each query and its k best gains; the relevant rows found at rank k or before."""
    ideal = qrels.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "id"))).where(F.col("_r") <= k)
    ideal = ideal.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.coalesce(F.col("rel").cast("double"), F.lit(0.0)).alias("rel")))), lambda x: x["rel"]).alias("best_rels"))
    totals = qrels.groupBy("query_id").agg(F.count("*").alias("n")).join(ideal, "query_id")
    return totals, _first(ranked, k).join(qrels, ["query_id", "id"]).select("query_id", "id", "rank", "rel")


def judged_by_class(ranked: DataFrame, queries: DataFrame, rows: DataFrame, k: int, itself: bool = True) -> tuple[DataFrame, DataFrame]:
    """judged() where the rows of a query's own class are relevant, all alike, of queries(query_id, class) and rows(id, class); `itself`: also the row whose id is the query's.

    The relevant rows are counted by class and looked up for the found rows only: as tables they grow with queries times rows.
    """
    asked, sizes = queries.select("query_id", "class"), rows.groupBy("class").agg(F.count("*").alias("n"))
    totals = asked.join(sizes, "class")
    hits = _first(ranked, k).join(asked, "query_id").join(rows.select("id", "class"), ["id", "class"])
    if not itself:
        own = asked.join(rows.select(F.col("id").alias("query_id"), "class"), ["query_id", "class"]).groupBy("query_id").agg(F.count("*").alias("own"))
        totals = totals.join(own, "query_id", "left").withColumn("n", F.col("n") - F.coalesce("own", F.lit(0)))
        hits = hits.where("id <> query_id")
    rels = F.expr(f"array_repeat(1D, cast(least(n, {k}) AS int))")
    return totals.where("n > 0").select("query_id", "n", rels.alias("best_rels")), hits.select("query_id", "id", "rank", F.lit(1).alias("rel"))


def _first(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.groupBy("query_id", "id").agg(F.min("rank").alias("rank")).where(F.col("rank") <= k)


def judged_scores(totals: DataFrame, hits: DataFrame, k: int, cuts: tuple[int, ...] = ()) -> DataFrame:
    """(query_id, recall, mrr, ndcg, hit) at k of judged(), and recall_K for each cut. A query without a result scores 0."""
    there = F.col("rank") <= k
    gain = F.when(there, (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("rank") + 1))
    found = {"recall": k} | {f"recall_{c}": c for c in cuts}
    got = hits.groupBy("query_id").agg(F.min(F.when(there, F.col("rank"))).alias("best"), F.sum(gain).alias("dcg"), *[F.count_if(F.col("rank") <= c).alias(f"_{name}") for name, c in found.items()])
    ideal = F.expr(f"aggregate(transform(slice(best_rels, 1, {k}), (r, i) -> (pow(2D, r) - 1) / log2(i + 2)), 0D, (s, x) -> s + x)")
    j = totals.join(got, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 9)
    recall = {name: zero(F.col(f"_{name}") / F.col("n")).alias(name) for name in found}
    return j.select("query_id", recall.pop("recall"), zero(1.0 / F.col("best")).alias("mrr"), zero(F.try_divide(F.col("dcg"), ideal)).alias("ndcg"), F.col("best").isNotNull().alias("hit"), *recall.values())


def per_query(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """ranked(query_id, id, rank), qrels(query_id, id, rel > 0) -> (query_id, recall, mrr, ndcg, hit) at k. A query without a result scores 0."""
    return judged_scores(*judged(ranked, qrels, k), k)


def means(scores: DataFrame, *by: str) -> DataFrame:
    return scores.groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "mrr", "ndcg")], F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"))


def buckets(scores: DataFrame, axes: list[str]) -> DataFrame:
    """(axis, bucket, n, means): every axis in one pass over its values."""
    e = scores.select("recall", "mrr", "ndcg", "hit", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("bucket")) for a in axes])).alias("x"))
    return means(e.select("recall", "mrr", "ndcg", "hit", "x.axis", "x.bucket"), "axis", "bucket")


def gold_score(hits: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """hits(query_id, rank, text), terms(query_id, term): the rank by which all terms have been seen. (query_id, satisfied_rank, missing)"""
    j = terms.join(hits.where(F.col("rank") <= k), "query_id", "left")
    seen = j.groupBy("query_id", "term").agg(F.min(F.when(F.contains(F.lower("text"), F.lower("term")), F.col("rank"))).alias("at"))
    return seen.groupBy("query_id").agg(F.when(F.count_if(F.col("at").isNull()) == 0, F.max("at")).alias("satisfied_rank"), F.count_if(F.col("at").isNull()).alias("missing"))


def baseline_diff(now: DataFrame, base: DataFrame, slack: float = 0.02) -> DataFrame:
    """now and base (variant, metric, value) -> with regressed: below base by more than slack, relatively."""
    j = base.select("variant", "metric", F.col("value").alias("base")).join(now.select("variant", "metric", "value"), ["variant", "metric"], "left")
    return j.withColumn("regressed", F.coalesce(F.col("value") < F.col("base") * (1 - slack), F.lit(True)))


def field_stats(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """(field, kind, distinct, low, high)"""
    names = [*((n, "numeric") for n in numeric), *((n, "string") for n in text)]
    # one scan: a row a field and value, then a row a value, then a row a field; no field's values meet in one task
    value = lambda n, kind: F.struct(F.lit(n).alias("field"), F.lit(kind).alias("kind"), F.col(n).cast("string").alias("s"), (F.col(n).cast("double") if kind == "numeric" else F.lit(None).cast("double")).alias("x"))
    each = df.select(F.explode(F.array(*[value(n, k) for n, k in names])).alias("v")).select("v.*").groupBy("field", "kind", "s").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return each.groupBy("field", "kind").agg(F.count("s").alias("distinct"), F.min("low").alias("low"), F.max("high").alias("high"))


CUTS = (1, 5, 10, 20)


def at_cuts(ranked: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """(n, recall_K for each cut, mrr_10, ndcg_10, hit_rate_10): means over all judged queries."""
    return cut_means(*judged(ranked, qrels, max(*cuts, 10)), cuts)


def cut_means(totals: DataFrame, hits: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """at_cuts() of judged() at the largest cut, or at 10 if that is more. All cuts in one pass over the ranked rows."""
    s = judged_scores(totals, hits, 10, cuts)
    means = {**{f"recall_{k}": f"recall_{k}" for k in cuts}, "mrr_10": "mrr", "ndcg_10": "ndcg"}
    return s.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(name) for name, c in means.items()], F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate_10"))


def by_document(ranked: DataFrame) -> DataFrame:
    """ranked(query_id, doc_id, rank) of chunks: each document once, at its first chunk's place, ranked anew."""
    first = ranked.groupBy("query_id", "doc_id").agg(F.min("rank").alias("_r"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_r", "doc_id")).cast("long")).drop("_r")


def gold_faults(gold: DataFrame, version: int) -> DataFrame:
    """(id, fault) of gold(id, question, must_contain_cve_ids, must_contain_terms): no rows, no faults."""
    bad = F.exists("must_contain_cve_ids", lambda c: ~c.rlike(r"^CVE-\d{4}-\d{4,}$"))
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    faults = F.filter(F.array(F.when(F.coalesce("id", F.lit("")) == "", "empty id"), F.when(F.trim(F.coalesce("question", F.lit(""))) == "", "empty question"), F.when(none("must_contain_cve_ids") & none("must_contain_terms"), "nothing to contain"), F.when(bad, "malformed CVE id")), lambda x: x.isNotNull())
    each = gold.select("id", F.explode(faults).alias("fault"))
    twice = gold.where("id <> ''").groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("fault"))
    out = each.unionByName(twice)
    return out if version >= 1 else out.unionByName(gold.sparkSession.createDataFrame([(None, "version below 1")], "id string, fault string"))


def gold_entries(hits: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(id, hit_1, hit_5, hit_10, reciprocal_rank, missing) of hits(id, rank, text): an entry is satisfied at the rank by which the chunks so far hold all its CVE ids and terms, in any case."""
    need = gold.select("id", F.explode(F.concat(F.transform(F.coalesce("must_contain_cve_ids", F.array().cast("array<string>")), lambda c: F.struct(F.lit(True).alias("cve"), c.alias("what"))), F.transform(F.coalesce("must_contain_terms", F.array().cast("array<string>")), lambda c: F.struct(F.lit(False).alias("cve"), c.alias("what"))))).alias("n")).select("id", "n.cve", "n.what")
    h = hits.where(F.col("rank") <= k).select("id", "rank", F.lower("text").alias("low"), F.expr("transform(regexp_extract_all(text, '(?i)CVE-\\\\d{4}-\\\\d+', 0), x -> upper(x))").alias("cves"))
    there = F.when(F.col("cve"), F.array_contains("cves", F.upper("what"))).otherwise(F.contains("low", F.lower("what")))
    seen = need.join(h, "id", "left").groupBy("id", "cve", "what").agg(F.min(F.when(there, F.col("rank"))).alias("at"))
    g = seen.groupBy("id").agg(F.when(F.count_if(F.col("at").isNull()) == 0, F.max("at")).alias("at"), F.array_sort(F.collect_list(F.when(F.col("at").isNull(), F.col("what")))).alias("missing"))
    return g.select("id", *[F.coalesce(F.col("at") <= n, F.lit(False)).alias(f"hit_{n}") for n in (1, 5, 10)], F.coalesce(1.0 / F.col("at"), F.lit(0.0)).alias("reciprocal_rank"), "missing")


def matrix(entries: DataFrame, axes: DataFrame | None = None) -> DataFrame:
    """(variant, axis, bucket, n, hit_1, hit_5, hit_10, mrr_10) of entries(variant, id, hit_*, reciprocal_rank): over all (axis `all`), and by each column of axes(id, ...)."""
    e = entries.withColumn("all", F.lit("all"))
    names = ["all"]
    if axes is not None:
        e, names = e.join(axes, "id"), ["all", *[c for c in axes.columns if c != "id"]]
    x = e.select("variant", "hit_1", "hit_5", "hit_10", "reciprocal_rank", F.explode(F.array(*[F.struct(F.lit(n).alias("axis"), F.col(n).cast("string").alias("bucket")) for n in names])).alias("x"))
    mean = lambda c: F.avg(F.col(c).cast("double"))
    return x.groupBy("variant", "x.axis", "x.bucket").agg(F.count("*").alias("n"), *[mean(f"hit_{n}").alias(f"hit_{n}") for n in (1, 5, 10)], mean("reciprocal_rank").alias("mrr_10"))


def _value(m: DataFrame, variant: str, metric: str, axis: str = "all", bucket: str = "all"):
    return F.max(F.when((F.col("variant") == variant) & (F.col("axis") == axis) & (F.col("bucket") == bucket), F.col(metric)))


#: Variants whose hit rate at five is taken from the primary one's: what reranking, context and fusion add.
DELTAS = {"rerank_delta": "no_rerank", "contextual_delta": "no_contextual", "hybrid_delta": "dense_only"}


def deltas(m: DataFrame) -> DataFrame:
    """One row of a matrix: the deltas, and route_regret (what knowing the intent adds to the detector, mrr on the recency bucket); null where a variant did not run."""
    regret = _value(m, "temporal_oracle", "mrr_10", "temporal_intent", "recency_seeking") - _value(m, "temporal_auto", "mrr_10", "temporal_intent", "recency_seeking")
    return m.agg(*[(_value(m, "primary", "hit_5") - _value(m, v, "hit_5")).alias(k) for k, v in DELTAS.items()], regret.alias("route_regret"))


def temporal_gates(m: DataFrame) -> DataFrame:
    """(gate, base, value, ok): the detector loses at most 0.02 on historical and 0.01 on neutral questions, nothing on recent ones, and is no better than the known intent. ok is true where a variant is absent."""
    v = lambda variant, metric, bucket: _value(m, variant, metric, "temporal_intent", bucket)
    rows = [
        ("historical", v("primary", "hit_5", "historical"), v("temporal_auto", "hit_5", "historical"), 0.02),
        ("neutral", v("primary", "hit_5", "neutral"), v("temporal_auto", "hit_5", "neutral"), 0.01),
        ("recency_seeking", v("primary", "mrr_10", "recency_seeking"), v("temporal_auto", "mrr_10", "recency_seeking"), 0.0),
        ("oracle", v("temporal_auto", "mrr_10", "recency_seeking"), v("temporal_oracle", "mrr_10", "recency_seeking"), 0.0),
    ]
    a = m.agg(*[c for g, x, y, _ in rows for c in (x.alias(f"{g}_base"), y.alias(f"{g}_value"))])
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(f"{g}_base").alias("base"), F.col(f"{g}_value").alias("value"), F.coalesce(F.col(f"{g}_value") >= F.col(f"{g}_base") - slack, F.lit(True)).alias("ok")) for g, _, _, slack in rows]))
    return a.select(each.alias("x")).select("x.*")


SLACK = 0.02


def regressions(now: DataFrame, base: DataFrame, bucket_slack: float = SLACK) -> DataFrame:
    """(variant, metric, baseline, current, delta, slack) of two matrices: hit_5 and mrr_10 over all that fell by more than SLACK of the baseline, and hit_5 of a bucket by more than bucket_slack. Variants and buckets that did not run are passed over."""
    j = base.alias("b").join(now.alias("n"), ["variant", "axis", "bucket"])
    metric = lambda name, col, all_: F.struct(F.lit(all_).alias("all"), F.lit(name).alias("metric"), F.col(f"b.{col}").alias("baseline"), F.col(f"n.{col}").alias("current"))
    x = j.select("variant", "axis", "bucket", F.explode(F.array(metric("hit@5", "hit_5", True), metric("MRR@10", "mrr_10", True), metric("hit_at_5", "hit_5", False))).alias("m")).where((F.col("axis") == "all") == F.col("m.all"))
    name = F.when(F.col("m.all"), F.col("m.metric")).otherwise(F.concat("m.metric", F.lit("["), "axis", F.lit("."), "bucket", F.lit("]")))
    slack = F.when(F.col("m.all"), F.lit(SLACK)).otherwise(F.lit(bucket_slack))
    low = F.when(F.col("m.all"), F.col("m.current") < F.col("m.baseline") * (1 - SLACK)).otherwise(F.col("m.current") - F.col("m.baseline") + bucket_slack < 0)
    return x.where(low).select("variant", name.alias("metric"), "m.baseline", "m.current", (F.col("m.current") - F.col("m.baseline")).alias("delta"), slack.alias("slack"))


STAGES = ("embed_us", "bm25_us", "hnsw_us", "rerank_us", "fuse_us")


def latency(times: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """(stage, p50, p95, p99, total) of times with a column of microseconds a stage, and `total_us`, their sum."""
    t = times.withColumn("total_us", sum((F.coalesce(F.col(s), F.lit(0)) for s in stages), F.lit(0)))
    x = t.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.coalesce(F.col(s), F.lit(0)).cast("long").alias("us")) for s in (*stages, "total_us")])).alias("x")).select("x.*")
    return x.groupBy("stage").agg(*[F.percentile("us", q / 100).alias(f"p{q}") for q in (50, 95, 99)], F.sum("us").alias("total"))


REPORT = 1


def report(metrics: DataFrame, **about) -> DataFrame:
    """(json): one versioned envelope of a small table of metrics and what it was measured on."""
    rows = metrics.agg(F.collect_list(F.struct(*metrics.columns)).alias("metrics"))
    head = [F.lit(REPORT).alias("schema_version"), *[F.lit(v).alias(k) for k, v in about.items()]]
    return rows.select(F.to_json(F.struct(*head, "metrics")).alias("json"))
