"""Licence scan: a trained paragraph classifier in built-in functions.

A paragraph (a `\\n`-split part of a text) is described by its word unigrams and bigrams. A multinomial logistic regression,
trained on the driver from the templates below (with words left out at random, and ordinary sentences as the unknown
class), gives each family log-odds in whole millionths. Calibration: the temperature is fitted on held-out variants, and a
family needs a probability of at least CONFIDENCE, else the paragraph is unknown. A prediction is confirmed if the
paragraph holds at least COVER percent of the n-grams of one of the family's templates.

Every template holds one of the anchor words (a cover that is computed from the templates). That does not hold for every
paragraph that covers COVER percent of a template, so the gate has more words: of each template so many that the n-grams
without them are under COVER percent. A paragraph without any gate word can't be confirmed; it is passed over by plain
substring tests before its n-grams are built. n_candidates counts the paragraphs with an anchor word only, so it can be less
than the number of confirmed ones. One projection, no shuffle.

Null or empty text: no paragraphs. Very long paragraphs: whole. Repeated rows: one row each. Empty table: empty result.
Extra columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

# Sentences by which the families are granted or named.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license version 2 0", "you may not use this file except in compliance with the license", "released under the apache license 2 0", "you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted", "released under the bsd license", "licensed under the 3 clause bsd license", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license", "this work is licensed under cc by 4 0", "available under the creative commons attribution license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "this work is licensed under cc by nc 4 0"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "this work is licensed under cc by sa 4 0", "text is available under the creative commons attribution sharealike license"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "licensed under the gnu gpl version 3", "released under the gnu general public license"],
    "mit": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "the software is provided as is without warranty of any kind express or implied"],
    "proprietary": ["all rights reserved", "copyright all rights reserved", "no part of this work may be reproduced without written permission", "unauthorized copying of this file is strictly prohibited"],
    "public-domain": ["this work is dedicated to the public domain", "released into the public domain", "released under cc0 1 0 universal", "to the extent possible under law the author has waived all copyright and related rights to this work"],
}
ORDINARY = ["the driver showed a license to the police officer", "she has a license to teach at the public school", "he was granted permission to enter the building", "the copyright of the song was sold last year", "they reserved all rooms in the hotel for the night", "human rights are reserved for everyone in the law", "the public library is free of charge for children", "the warranty covers repair of the machine", "the apache helicopter landed near the base", "a license plate was found in the forest", "the general spoke to the public about the version of events", "mit is a university in cambridge", "the software was released in spring", "a commons is land that is open to all", "the law was under attack and parts of it were removed", "the company sells the product under license in europe", "fishing without a permit is prohibited", "the terms of the contract were read aloud"]
FAMILIES = [*TEMPLATES, "unknown"]
CONFIDENCE, COVER, SCALE = 0.5, 60, 1_000_000
COMMON = {"the", "and", "this", "under", "for", "any", "with", "you", "may", "not", "are", "all"}


def grams(text: str) -> list[str]:
    w = [x for x in re.split(r"[^0-9a-z]+", text) if x]
    return sorted({*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))})


@lru_cache(1)
def anchors() -> tuple[str, ...]:
    """Words of which every template holds one: greedily the one that covers most, in order."""
    left, found = [set(re.split(r"[^0-9a-z]+", t)) for v in TEMPLATES.values() for t in v], []
    while left:
        words = sorted({w for t in left for w in t if len(w) > 2 and w not in COMMON})
        best = max(words, key=lambda w: (sum(w in t for t in left), w))
        found.append(best)
        left = [t for t in left if best not in t]
    return tuple(found)


@lru_cache(1)
def gate() -> tuple[str, ...]:
    """The anchors, and words until the n-grams of each template that hold none of them are under COVER percent of it."""
    found, every = list(anchors()), [g for ts in _cover().values() for g in ts]
    rest = lambda g: [q for q in g if not set(q.split()) & set(found)]
    while left := [g for g in every if 100 * len(rest(g)) >= COVER * len(g)]:
        words = sorted({w for g in left for q in rest(g) for w in q.split()})
        gain = {w: sum(sum(w in q.split() for q in rest(g)) / len(g) for g in left) for w in words}
        found.append(max(words, key=lambda w: (len(w) > 2 and w not in COMMON, gain[w], w)))
    return tuple(found)


@lru_cache(1)
def model() -> tuple[tuple[str, ...], np.ndarray]:
    """(n-grams, whole-millionth weights by family with the bias as the last row), the temperature folded in."""
    rng = np.random.default_rng(11)
    texts, y = [], []
    for k, (f, ts) in enumerate([*TEMPLATES.items(), ("unknown", ORDINARY)]):
        for t in ts:
            w = t.split()
            for r in range(24):
                kept = w if r == 0 else [x for x in w if rng.random() > 0.12] or w
                extra = list(rng.choice(ORDINARY).split()) if r % 3 == 2 else []
                texts.append(" ".join([*kept, *extra]))
                y.append(k)
    vocabulary = sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(t)} | {g for t in ORDINARY for g in grams(t)})
    number, y = {g: i for i, g in enumerate(vocabulary)}, np.array(y)
    x = np.zeros((len(texts), len(vocabulary) + 1))
    x[:, -1] = 1
    for i, t in enumerate(texts):
        x[i, [number[g] for g in grams(t) if g in number]] = 1
    held = np.arange(len(y)) % 6 == 5
    w, truth = np.zeros((x.shape[1], len(FAMILIES))), np.eye(len(FAMILIES))[y]
    for _ in range(300):
        z = x[~held] @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= 1.0 * (x[~held].T @ (p - truth[~held]) / (~held).sum() + 1e-4 * w)

    def loss(t: float) -> float:
        z = x[held] @ w / t
        z -= z.max(1, keepdims=True)
        return -(z[np.arange(held.sum()), y[held]] - np.log(np.exp(z).sum(1))).mean()

    t = min(np.linspace(0.3, 3, 28), key=loss)
    return tuple(vocabulary), np.rint(w / t * SCALE).astype(np.int64)


def _cover() -> dict[str, list[list[str]]]:
    return {f: [grams(t) for t in ts] for f, ts in TEMPLATES.items()}


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns with n_paragraphs, n_candidates and `licences`: an array of (place, family, confirmed) of the paragraphs that hold a gate word."""
    vocabulary, w = model()
    quote = lambda s: "'" + s + "'"
    known = "array(" + ", ".join(map(quote, vocabulary)) + ")"
    weights = "array(" + ", ".join("array(" + ", ".join(f"{v}L" for v in row) + ")" for row in w[:-1]) + ")"
    bias = w[-1]
    holds = lambda x, words: " OR ".join(f"{x} LIKE '%{a}%'" for a in words)
    words = "array_remove(split(x.low, '[^0-9a-z]+'), '')"
    gram = "array_distinct(concat(z, CASE WHEN size(z) < 2 THEN array() ELSE transform(sequence(0, size(z) - 2), i -> concat(z[i], ' ', z[i + 1])) END))"
    one = lambda v, inner, name: f"element_at(transform(array({v}), {name} -> {inner}), 1)"
    scores = "array(" + ", ".join(f"{int(bias[k])}L + aggregate(f, 0L, (s, q) -> s + weight[q - 1][{k}])" for k in range(len(FAMILIES))) + ")"
    cover = _cover()
    confirmed = "CASE " + " ".join(f"WHEN best = {k + 1} THEN " + " OR ".join(f"100 * size(array_intersect(g, array({', '.join(map(quote, t))}))) >= {COVER * len(t)}" for t in cover[f]) for k, f in enumerate(FAMILIES[:-1])) + " ELSE false END"
    d = docs.withColumns({"_p": F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), "\n")})
    d = d.withColumn("n_paragraphs", F.expr(r"size(filter(_p, x -> x rlike '[^\\x20\\x09-\\x0D]'))").cast("long"))
    d = d.withColumn("_l", F.expr(f"filter(transform(_p, (x, i) -> struct(x AS low, i AS place)), x -> {holds('x.low', gate())})"))
    d = d.withColumn("n_candidates", F.expr(f"size(filter(_l, x -> {holds('x.low', anchors())}))").cast("long"))
    d = d.withColumn("_g", F.expr(f"transform(_l, x -> struct(x.place AS place, {one(words, gram, 'z')} AS g))"))
    d = d.withColumns({"_known": F.when(F.size("_g") > 0, F.expr(known)), "_w": F.when(F.size("_g") > 0, F.expr(weights))})
    d = d.withColumn("_f", F.expr("transform(_g, x -> struct(x.place AS place, x.g AS g, transform(array_intersect(x.g, _known), q -> int(array_position(_known, q))) AS f))"))
    d = d.withColumn("_s", F.expr(f"transform(_f, x -> struct(x.place AS place, x.g AS g, {scores.replace('aggregate(f,', 'aggregate(x.f,').replace('weight[', '_w[')} AS s))"))
    d = d.withColumn("_b", F.expr(f"transform(_s, x -> struct(x.place AS place, x.g AS g, int(array_position(x.s, array_max(x.s))) AS best, 1 / aggregate(x.s, 0D, (a, v) -> a + exp((v - array_max(x.s)) / {SCALE}D)) AS p))"))
    names = "array(" + ", ".join(map(quote, FAMILIES)) + ")"
    d = d.withColumn("licences", F.expr(f"transform(_b, x -> struct(x.place AS place, if(x.p >= {CONFIDENCE}, {names}[x.best - 1], 'unknown') AS family, x.p >= {CONFIDENCE} AND {confirmed.replace('best', 'x.best').replace('(g,', '(x.g,')} AS confirmed))"))
    return d.drop("_p", "_l", "_g", "_known", "_w", "_f", "_s", "_b")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = paragraphs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sure = F.expr("filter(licences, x -> x.confirmed)")
    return d.select("doc_id", "n_paragraphs", "n_candidates", F.size(sure).cast("long").alias("n_licences"), F.array_join(F.array_sort(F.array_distinct(sure["family"])), ",").alias("licences"))


def sql() -> str:
    vocabulary, w = model()
    anchor = " OR ".join(f"contains(low, '{a}')" for a in anchors())
    rows = ", ".join(f"('{g}', {[int(v) for v in row]})" for g, row in zip(vocabulary, w[:-1]))
    marks = ", ".join(f"('{f}', {t}, {k * 100 + i})" for k, (f, ts) in enumerate(_cover().items()) for i, t in enumerate(ts))
    n = len(FAMILIES)
    sums = ", ".join(f"CAST({int(w[-1][k])} + coalesce(sum(v.w[{k + 1}]), 0) AS BIGINT)" for k in range(n))
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS p FROM documents),
l AS (SELECT row_no, place, p[place] AS low FROM (SELECT row_no, p, unnest(range(1, len(p) + 1)) AS place FROM d)),
g AS (SELECT row_no, place, list_distinct(list_concat(z, list_transform(range(1, greatest(1, len(z))), lambda i: z[i] || ' ' || z[i + 1]))) AS g FROM (SELECT row_no, place, list_filter(regexp_split_to_array(low, '[^0-9a-z]+'), lambda x: x <> '') AS z FROM l )),
v(g, w) AS (VALUES {rows}),
t(family, g, no) AS (VALUES {marks}),
s AS (SELECT row_no, place, [{sums}] AS s FROM (SELECT row_no, place, unnest(g) AS q FROM g UNION ALL SELECT row_no, place, NULL FROM g) LEFT JOIN v ON v.g = q GROUP BY row_no, place),
b AS (SELECT row_no, place, {FAMILIES}[list_position(s, list_max(s))] AS family, 1 / list_sum(list_transform(s, lambda x: exp((x - list_max(s)) / {SCALE}e0))) AS p FROM s),
c AS (SELECT b.row_no, b.place, b.family FROM b JOIN g USING (row_no, place) WHERE p >= {CONFIDENCE} AND EXISTS (SELECT 1 FROM t WHERE t.family = b.family AND 100 * len(list_intersect(g.g, t.g)) >= {COVER} * len(t.g))),
a AS (SELECT row_no, count(*) AS n, string_agg(DISTINCT family, ',' ORDER BY family) AS families FROM c GROUP BY row_no),
k AS (SELECT row_no, count(*) AS n FROM l WHERE {anchor} GROUP BY row_no)
SELECT doc_id, CAST(len(list_filter(p, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) AS BIGINT) AS n_paragraphs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_candidates, CAST(coalesce(a.n, 0) AS BIGINT) AS n_licences, coalesce(families, '') AS licences FROM d LEFT JOIN a USING (row_no) LEFT JOIN k USING (row_no)"""
