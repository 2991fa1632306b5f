"""URL filters: host and path rules, and a logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from the small labelled table below (URLs made by rule from words that name kinds of
unwanted and of ordinary sites, on usual top-level names, with paths of both kinds and neutral ones). Its features are the
counts of the n-grams, unscaled, so that what is fitted is what is scored; its weights are rounded to whole millionths, so
that every engine sums to the same score. Scoring is one projection of built-in functions: no shuffle, no Python. Rules come
first (the longest that fits), the model judges what no rule fits.

Null url or one without `://`: empty host and path, no rule; the model allows what has no n-gram. Very long urls: whole.
Repeated rows: one row each. Empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table

# The rules of the contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
# The labelled table's parts: words that name unwanted and ordinary sites, top-level names, and paths by kind.
BAD = ["casino", "poker", "blackjack", "roulette", "betting", "wager", "slots", "jackpot", "lottery", "sweepstakes", "giveaway", "pills", "viagra", "cialis", "steroids", "weightloss", "replica", "knockoff", "adult", "xxx", "porn", "webcam", "escort", "dating", "hookup", "adserver", "tracker", "popunder", "clickbait", "spam", "linkfarm", "warez", "torrent", "cracked", "keygen", "serials", "payday", "loans", "forex", "crypto"]
GOOD = ["news", "gazette", "tribune", "herald", "library", "archive", "museum", "gallery", "university", "college", "academy", "institute", "journal", "research", "physics", "biology", "history", "geography", "encyclopedia", "dictionary", "recipes", "garden", "weather", "travel", "railway", "hospital", "clinic", "council", "parliament", "ministry", "theatre", "orchestra", "football", "cycling", "docs", "manual", "forum", "software", "bakery", "carpentry"]
TOPS = ["com", "net", "org", "info", "co.uk", "de", "fr", "es"]
BAD_PATHS = ["/bonus/free-spins", "/win/now", "/buy-cheap/{}", "/click/out/{}", "/promo/{}.php", "/best-price/order"]
GOOD_PATHS = ["/articles/{}", "/docs/guide.html", "/about/contact", "/{}/chapter-2.html", "/index.html", "/archive/{}/issue"]
NEUTRAL_PATHS = ["/", "/{}", "/en/{}", "/de/{}", "/fr/{}.html", "/es/{}/"]
BITS, GRAM = 12, 4
SCALE = 1_000_000
#: Log-odds that the model must be sure by before it blocks.
MARGIN = 0.5


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, unwanted): each word on four hosts, alone and beside another word of its kind, half of them with neutral paths."""
    rows = []
    for words, paths, y in ((BAD, BAD_PATHS, 1), (GOOD, GOOD_PATHS, 0)):
        for i, w in enumerate(words):
            for k in range(4):
                n = i * 4 + k
                host = (w, "www." + w, w + "-" + words[(i * 7 + 3) % len(words)], "my" + w)[k] + "." + TOPS[n % len(TOPS)]
                path = (paths if k % 2 else NEUTRAL_PATHS)[n * 5 % 6].format(n * 7919 % 99991)
                rows.append((host, path, y))
    return rows


def grams(host: str, path: str) -> list[int]:
    """Bucket of each character n-gram of host and path; the digits of the path are not told apart."""
    s = "^" + host + "".join("0" if c.isascii() and c.isdigit() else c for c in path) + "$"
    if not host and not path:
        return []
    return [(((ord(s[i]) * 131 + ord(s[i + 1])) * 131 + ord(s[i + 2])) * 131 + ord(s[i + 3])) * 40503 % 1000003 % (1 << BITS) for i in range(len(s) - GRAM + 1)]


def fit(rows: list[tuple[str, str, int]]) -> tuple[int, ...]:
    """Millionths: the bias, then a weight for each bucket; full-batch gradient descent on n-gram counts with L2 shrinkage."""
    found = [grams(h, p) for h, p, _ in rows]
    used = sorted({g for f in found for g in f})
    number, y = {g: i for i, g in enumerate(used)}, np.array([r[2] for r in rows], float)
    x = np.zeros((len(rows), len(used)))
    for i, f in enumerate(found):
        for g in f:
            x[i, number[g]] += 1
    w, b = np.zeros(len(used)), 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w -= 0.2 * (x.T @ (p - y) / len(y) + 1e-3 * w)
        b -= 0.2 * (p - y).mean()
    out = np.zeros(1 + (1 << BITS))
    out[0], out[1 + np.array(used, np.int64)] = b - MARGIN, w
    return tuple(int(v) for v in np.rint(out * SCALE))


@lru_cache(1)
def weights() -> tuple[int, ...]:
    return fit(labelled_urls())


def host_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_column(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, prefix, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule, verdict = F.when(fits, name + prefix).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """pages' columns with host, path, rule, score (whole number, positive: unwanted) and verdict."""
    w = weights()
    host, path = host_path(F.col(url))
    df = pages.withColumns({"host": host, "path": path})
    masked = F.when((F.col("host") == "") & (F.col("path") == ""), "").otherwise(F.concat(F.lit("^"), "host", F.regexp_replace("path", "[0-9]", "0"), F.lit("$")))
    df = df.withColumn("_c", F.transform(F.split(masked, ""), lambda c: F.ascii(c).cast("long")))
    df = df.withColumn("_g", F.when(F.char_length(masked) < GRAM, F.array().cast("array<int>")).otherwise(F.expr(f"transform(sequence(0, size(_c) - {GRAM}), i -> cast((((_c[i] * 131 + _c[i + 1]) * 131 + _c[i + 2]) * 131 + _c[i + 3]) * 40503 % 1000003 % {1 << BITS} AS int))")))
    literal = "array(" + ", ".join(f"{v}L" for v in w[1:]) + ")"
    df = df.withColumn("score", F.expr(f"if(size(_g) = 0, 0L, {w[0]}L + aggregate(_g, 0L, (s, g) -> s + {literal}[g]))"))
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    return df.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow"))).drop("_c", "_g")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def sql() -> str:
    w = weights()
    rule, verdict = "NULL", "NULL"
    for name, prefix, what in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{prefix}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{name + prefix}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{what}' ELSE {verdict} END"
    code = lambda k: f"CAST(unicode(s[i + {k}]) AS BIGINT)"
    bucket = f"((({code(0)} * 131 + {code(1)}) * 131 + {code(2)}) * 131 + {code(3)}) * 40503 % 1000003 % {1 << BITS}"
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{pattern}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{pattern}', 2), '') AS path FROM pages),
s AS (SELECT *, CASE WHEN host = '' AND path = '' THEN '' ELSE '^' || host || regexp_replace(path, '[0-9]', '0', 'g') || '$' END AS s FROM u),
weights AS (SELECT {list(w[1:])} AS w),
g AS (SELECT *, list_transform(range(1, greatest(1, length(s) - {GRAM} + 2)), lambda i: {bucket}) AS g FROM s),
z AS (SELECT g.*, CASE WHEN len(g) = 0 THEN 0 ELSE {w[0]} + list_sum(list_transform(g, lambda b: w[b + 1])) END AS score FROM g, weights)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM z"""
