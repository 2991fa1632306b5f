"""Quality classifier: hierarchical empirical Bayes over document, path and host.

Evidence: a logistic regression on a document's character and word statistics, fitted to at most FIT_ROWS labelled documents
(those with the smallest hashed ids). Its probabilities are summed by path and by host in grouped aggregations over all
documents. A host's posterior is its mean shrunk toward the global mean, a path's is its mean shrunk toward its host's
posterior; the strengths of both priors come from the spread of the means (method of moments), so sparse sites stay near
their prior. A document's log-odds are its own plus those of its path over the global ones.

The documents table has no url: `source` is the host and `lang` the path below it; other columns can be named.
Null host or path: a site of that name. Null or empty text: judged on zero statistics. Repeated rows: one each. No labels:
evidence 0.5 for all. Empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .op9_quality_rules import counts

FIT_ROWS = 20_000
KEEP_FROM = 0.5
HASHES = 1 << 40
#: SQL of each statistic over op9's counts.
FEATURES = [f"coalesce(try_divide(cast({x} AS double), {y}), 0D)" for x, y in [("c_lower", "n_chars"), ("c_upper", "n_chars"), ("c_digit", "n_chars"), ("c_symbol", "n_chars"), ("c_punct", "n_chars"), ("c_other", "n_chars"), ("n_repeat_words", "n_words"), ("n_dup_lines", "n_words"), ("n_words - k_rest", "n_words")]] + ["least(coalesce(try_divide(cast(word_chars AS double), n_words), 0D), 30D)", "ln(1D + n_words)"]


def statistics(docs: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """(doc_id, host, path, x): x is the array of FEATURES."""
    # counts() keeps the rows' order and columns apart, so the site travels inside doc_id
    s = counts(docs.select(F.struct(F.col("doc_id").alias("id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path")).alias("doc_id"), "text", F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")))
    return s.select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.host").alias("host"), F.col("doc_id.path").alias("path"), F.expr(f"array({', '.join(FEATURES)})").alias("x"))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights on raw statistics and the bias, by Newton steps with a ridge."""
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(len(FEATURES)), 0.0
    mid, wide = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mid) / wide, np.ones((len(y), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) / len(y) + ridge * w
        hess = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        move = np.linalg.solve(hess, g)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w[:-1] / wide, float(w[-1] - (w[:-1] * mid / wide).sum())


def _odds(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _strength(within: float, between: float) -> float:
    """Rows that a prior is worth: the spread inside the sites over the spread between them."""
    return min(1e4, max(1.0, within / between)) if between > 0 else 1e4


def _fit_rows(marked: DataFrame, most: int) -> list:
    """The `most` rows with the smallest hashed ids. They are thinned on the executors by a bound on the hash, so that all
    tasks together send little more than `most` rows; the bound is doubled until enough lie below it."""
    marked = marked.withColumn("_h", F.pmod(F.xxhash64("_id"), F.lit(HASHES)))
    n = marked.count()
    bound = HASHES if n <= most else int(HASHES * (most * 1.05 + 100) / n)
    while bound < HASHES and marked.where(F.col("_h") < bound).count() < most:
        bound *= 2
    return marked.where(F.col("_h") < bound).orderBy("_h", "_id").limit(most).select("x", "quality").collect()


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, evidence, host_posterior, path_posterior, quality, kept)"""
    s = cut(statistics(docs, host, path))
    marked = labels.where("quality IS NOT NULL").select(F.col("doc_id").alias("_id"), "quality")
    rows = _fit_rows(s.join(marked, s.doc_id == marked["_id"]).select("_id", "x", "quality"), fit_rows)
    w, b = fit(np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r.quality for r in rows], float))
    logit = F.lit(b) + sum((F.element_at("x", i + 1) * float(v) for i, v in enumerate(w)), F.lit(0.0))
    d = s.withColumn("evidence", 1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0))))).select("doc_id", "host", "path", "evidence")
    sums = [F.count("*").alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") * F.col("evidence")).alias("q")]
    paths = cut(d.groupBy("host", "path").agg(*sums))
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq")))
    g = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.sum(F.col("hq") - F.col("hs") * F.col("hs") / F.col("hn")).alias("inside"), F.count("*").alias("k"), F.avg(F.col("hs") / F.col("hn")).alias("m"), F.var_pop(F.col("hs") / F.col("hn")).alias("spread")).first()
    n = g.n or 0
    mean = (g.s / n) if n else 0.5
    host_k = _strength((g.inside or 0) / max(n, 1), g.spread or 0)
    near = paths.join(hosts, paths.host.eqNullSafe(hosts.host)).select(paths.host, "path", "n", "s", "q", "hn", "hs")
    p = near.agg(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("inside"), F.avg((F.col("s") / F.col("n") - F.col("hs") / F.col("hn")) ** 2).alias("spread")).first()
    path_k = _strength((p.inside or 0) / max(n, 1), p.spread or 0)
    near = near.withColumn("host_posterior", (F.col("hs") + host_k * mean) / (F.col("hn") + host_k))
    near = near.withColumn("path_posterior", (F.col("s") + path_k * F.col("host_posterior")) / (F.col("n") + path_k)).select(F.col("host").alias("_h"), F.col("path").alias("_p"), "host_posterior", "path_posterior")
    base = math.log(min(max(mean, 1e-6), 1 - 1e-6) / (1 - min(max(mean, 1e-6), 1 - 1e-6)))
    j = d.join(near, d.host.eqNullSafe(near["_h"]) & d.path.eqNullSafe(near["_p"]))
    total = _odds(F.col("evidence")) + _odds(F.col("path_posterior")) - base
    j = j.withColumn("quality", 1 / (1 + F.exp(-total)))
    return j.withColumn("kept", F.col("quality") >= KEEP_FROM).select("doc_id", "evidence", "host_posterior", "path_posterior", "quality", "kept")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
