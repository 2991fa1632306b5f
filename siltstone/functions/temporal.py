"""Time decay: factors, policies and the abstaining recency detector. `now` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Half-life in days and floor of each strength; score factor of rows without a date.
LADDER = {"light": (365, 0.75), "medium": (180, 0.60), "strong": (60, 0.45)}
PRIOR = 1.0
# What asks for recent things. A word of recency needs a security noun within a few words behind it; the year
# 2026 needs one on either side, and is looked for with CVE ids masked.
_NOUN = r"advisory|exploit|bypass|cve|disclosure|vulnerabilit(?:y|ies)|patch|guidance"
_YEAR_NOUN = r"cve|vulnerabilit(?:y|ies)|advisory|disclosure|exploit|poc|mitigation|patch"
RECENT = [
    rf"(?i)\b(latest|newest|current(?:ly)?|newer)\b(?:\W+\w+){{0,6}}\W+({_NOUN}|kev|mitigation|poc)\b",
    rf"(?i)\brecent(?:ly)?\b(?:\W+\w+){{0,4}}\W+({_NOUN})\b",
    r"(?i)\bstill\s+(exploited|in\s+kev|vulnerable|unpatched)\b",
    r"(?i)\bas\s+of\s+(today|now|this\s+(week|month))\b",
    r"(?i)\bthis\s+(week|month)\b",
]
RECENT_YEAR = rf"(?i)(?:\b2026\b(?:\W+\w+){{0,4}}\W+({_YEAR_NOUN})\b|\b({_YEAR_NOUN})\b(?:\W+\w+){{0,4}}\W+\b2026\b)"
CVE_ID = r"(?i)\bCVE-\d{4}-\d{4,}\b"


def factor(date: Column, now: str, halflife: float, floor: float, prior: float = PRIOR) -> Column:
    age = F.greatest(F.datediff(F.lit(now).cast("date"), date), F.lit(0))
    return F.when(date.isNull(), F.lit(prior)).otherwise(floor + (1 - floor) * F.exp(-F.log(F.lit(2.0)) * age / halflife))


def multiplicative(hits: DataFrame, date: Column, now: str, halflife: float, floor: float) -> DataFrame:
    return hits.withColumn("score", F.col("score") * factor(date, now, halflife, floor))


def additive(hits: DataFrame, date: Column, now: str, halflife: float, alpha: float, prior: float = 0.5, by: str = "query_id") -> DataFrame:
    """alpha * the score scaled to 0..1 within its query (0.5 where all are equal) + (1 - alpha) * the decay.

    Bounds are grouped minima and maxima, one row a query, and are joined: a query with many rows is not gathered.
    """
    bounds = hits.groupBy(F.col(by).alias("_by")).agg(F.min("score").alias("_low"), F.max("score").alias("_high"))
    j = hits.join(bounds, F.col(by).eqNullSafe(F.col("_by")))
    unit = F.when(F.col("_high") > F.col("_low"), F.try_divide(F.col("score") - F.col("_low"), F.col("_high") - F.col("_low"))).otherwise(0.5)
    return j.withColumn("score", alpha * unit + (1 - alpha) * factor(date, now, halflife, 0.0, prior)).select(*hits.columns)


def extract_date(*fields: Column) -> Column:
    """The first of the fields that holds a date."""
    return F.coalesce(*[F.try_to_date(f.cast("string"), "yyyy-MM-dd") for f in fields])


def seeks_recent(text: Column) -> Column:
    out = F.regexp_replace(text, CVE_ID, "___").rlike(RECENT_YEAR)
    for p in RECENT:
        out = out | text.rlike(p)
    return F.coalesce(out, F.lit(False))


def policy(text: Column) -> Column:
    """The abstaining detector: medium where the text surely asks for recent things, else off."""
    return F.when(seeks_recent(text), "medium").otherwise("off")


def oracle_policy(intent: Column) -> Column:
    """By a known intent: medium for recency_seeking, else off."""
    return F.when(intent == "recency_seeking", "medium").otherwise("off")


def resolved(setting: Column, detected: Column) -> Column:
    """A query's policy setting (auto, off, light, medium, strong), with auto resolved by a detector."""
    return F.when(setting == "auto", detected).when(setting.isin(*LADDER), setting).otherwise("off")


def by_policy(hits: DataFrame, date: Column, now: str, strength: str = "policy") -> DataFrame:
    """Multiplicative decay at each row's own strength; off leaves the score."""
    out = F.col("score")
    for name, (halflife, floor) in LADDER.items():
        out = F.when(F.col(strength) == name, F.col("score") * factor(date, now, halflife, floor)).otherwise(out)
    return hits.withColumn("score", out)
