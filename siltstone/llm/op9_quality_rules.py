"""Quality rules by distribution divergence.

A document's character-class histogram and common-word histogram are held against those of its language by the
Jensen-Shannon divergence (base 2). The language references are summed over all documents of the language, so they are
exact integer counts. Short texts are noisy: the histograms are judged only above a minimum length.

Null text: no words, no characters, base rules fail. Empty text: the same. Repeated rows: judged one by one. Empty table:
empty result. Extra columns are not read; a column that clashes with a result's name is ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

# The ten most usual function words of each supported language.
COMMON = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "las", "del"],
}
K = 10
#: Largest divergence that is kept, and the lengths from which a histogram is judged.
MAX_CHAR_JSD, MIN_CHARS = 0.06, 200
MAX_WORD_JSD, MIN_WORDS = 0.05, 120
#: Base rules: fewest words, largest share of words in repeated windows (percent).
LEAST_WORDS, MAX_REPEAT = 50, 50

CHARS = ["c_lower", "c_upper", "c_digit", "c_space", "c_punct", "c_symbol", "c_other"]
WORDS = [f"k{i}" for i in range(K)] + ["k_rest"]

#: words found twice or more in 3-word windows: positions of such windows, then the words that they cover
_DUPS = "CASE WHEN size(array_distinct(h)) = size(h) THEN array() ELSE array_distinct(array_compact(zip_with(sort_array(h), slice(sort_array(h), 2, size(h)), (a, b) -> if(a = b, a, null)))) END"
_SORTED = "array_sort(transform(h, (x, i) -> struct(x AS x, i AS i)))"
_HITS = f"""CASE WHEN size(dups) = 0 THEN array() WHEN size(dups) <= 48 THEN filter(transform(h, (x, i) -> if(array_contains(dups, x), i, -1)), i -> i >= 0)
 ELSE sort_array(array_distinct(flatten(array_compact(zip_with(slice({_SORTED}, 1, size(h) - 1), slice({_SORTED}, 2, size(h) - 1), (a, b) -> if(a.x = b.x, array(a.i, b.i), null)))))) END"""
_COVERED = "CASE WHEN size(hits) = 0 THEN 0L ELSE 3L + aggregate(zip_with(slice(hits, 2, size(hits)), slice(hits, 1, size(hits) - 1), (b, a) -> least(3, b - a)), 0L, (s, x) -> s + x) END"


def _language() -> Column:
    return F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise("other")


def counts(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Integer counts per document: the base rules' and both histograms. No shuffle. With carry, a struct `_row` of docs' columns, too."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []
    n_of = lambda c: F.char_length(c).cast("long")
    lists = "CASE language " + " ".join(f"WHEN '{k}' THEN array({', '.join(map(repr, v))})" for k, v in COMMON.items()) + f" ELSE array({', '.join(repr('') for _ in range(K))}) END"
    a = docs.select("doc_id", _language().alias("language"), F.coalesce("text", F.lit("")).alias("text"), *row)
    a = a.withColumns({"w": F.expr(r"array_remove(split(text, '[\\x20\\x09-\\x0D]+'), '')"), "lines": F.expr(r"filter(split(text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"), "r1": F.expr("regexp_replace(text, '[a-z]+', '')"), "common": F.expr(lists)})
    a = a.withColumns({"r2": F.expr("regexp_replace(r1, '[A-Z]+', '')"), "n": n_of("text"), "n1": n_of("r1"), "h": F.expr("CASE WHEN size(w) < 3 THEN array() ELSE transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) END"), "w0": F.col("w")})
    for i in range(K):
        a = a.withColumn(f"w{i + 1}", F.expr(f"array_remove(w{i}, common[{i}])"))
    a = a.withColumns({"dups": F.expr(_DUPS), "n2": n_of("r2"), "r3": F.expr("regexp_replace(r2, '[0-9]+', '')")})
    a = a.withColumns({"hits": F.expr(_HITS), "n3": n_of("r3"), "r4": F.expr(r"regexp_replace(r3, '[\\x20\\x09-\\x0D]+', '')")})
    a = a.withColumns({"n4": n_of("r4"), "r5": F.expr(r"""regexp_replace(r4, '[.,;:!?()"-]+', '')""")})
    a = a.withColumns({"n5": n_of("r5"), "r6": F.expr(r"regexp_replace(r5, '[^\\x00-\\x7F]+', '')")})
    n_words = F.size("w").cast("long")
    return a.select(
        "doc_id", "language", n_words.alias("n_words"), n_of(F.array_join("w", "")).alias("word_chars"),
        (F.col("n5") - n_of(F.expr("regexp_replace(r5, '[#*$%&|<>]', '')"))).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.expr(_COVERED).alias("n_repeat_words"), F.col("n").alias("n_chars"),
        (F.col("n") - F.col("n1")).alias("c_lower"), (F.col("n1") - F.col("n2")).alias("c_upper"), (F.col("n2") - F.col("n3")).alias("c_digit"), (F.col("n3") - F.col("n4")).alias("c_space"), (F.col("n4") - F.col("n5")).alias("c_punct"), n_of("r6").alias("c_symbol"), (F.col("n5") - n_of("r6")).alias("c_other"),
        *[(F.size(f"w{i}") - F.size(f"w{i + 1}")).cast("long").alias(f"k{i}") for i in range(K)], F.size(f"w{K}").cast("long").alias("k_rest"), *(["_row"] if carry else []),
    )


def _jsd(mine: list[str], ref: list[str], n: str, m: str) -> str:
    """SQL, the same in Spark and DuckDB: divergence of counts mine/n from counts ref/m."""
    half = lambda p, q: f"CASE WHEN {p} = 0 THEN 0e0 ELSE 5e-1 * {p} * ln({p} / (5e-1 * ({p} + {q}))) END"
    part = lambda a, b: (f"(CAST({a} AS DOUBLE) / {n})", f"(CAST({b} AS DOUBLE) / {m})")
    return "(" + " + ".join(f"{half(*part(a, b))} + {half(*reversed(part(a, b)))}" for a, b in zip(mine, ref)) + ") / 0.6931471805599453e0"


BASE_FAILED = f"(n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words)"
CHAR_JSD = _jsd(CHARS, ["r_" + c for c in CHARS], "n_chars", "r_n_chars")
WORD_JSD = _jsd(WORDS, ["r_" + c for c in WORDS], "n_words", "r_n_words")
DIVERGES = f"(CASE WHEN n_chars < {MIN_CHARS} THEN false ELSE {CHAR_JSD} > {MAX_CHAR_JSD}e0 END OR CASE WHEN n_words < {MIN_WORDS} OR language = 'other' THEN false ELSE {WORD_JSD} > {MAX_WORD_JSD}e0 END)"


def judge(docs: DataFrame) -> DataFrame:
    """counts() with the divergences and the verdict. The references are five rows at most, one a language, so they are broadcast."""
    c = cut(counts(docs))
    return _verdicts(c, references(c))


def references(c: DataFrame) -> DataFrame:
    """The summed histograms of each language of counts()."""
    return c.groupBy("language").agg(*[F.sum(x).alias("r_" + x) for x in [*CHARS, *WORDS, "n_chars", "n_words"]])


def _verdicts(c: DataFrame, ref: DataFrame) -> DataFrame:
    j = c.join(F.broadcast(ref), "language", "left")
    return j.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", F.expr(f"NOT base_failed AND NOT {DIVERGES}"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns; each row is judged by itself.

    The texts are read twice and never shuffled: once for the references, once for the verdicts. Joining the verdicts to the
    texts instead would shuffle all texts as soon as the rejected ids are too many to broadcast.
    """
    ref = cut(references(counts(docs)))
    # greatest() keeps the optimizer from splitting the predicate and repeating the counts below the projections
    fails = F.expr(f"greatest(cast(base_failed AS int), cast({DIVERGES} AS int))")
    return _verdicts(counts(docs, carry=True), ref).where(fails == 0).select("_row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql(source: str = "documents") -> str:
    ws = r"[^\x20\x09-\x0D]+"
    out = lambda pattern: f"length(text) - length(regexp_replace(text, '{pattern}', '', 'g'))"
    word = lambda i: "CASE language " + " ".join(f"WHEN '{k}' THEN len(list_filter(w, lambda x: x = '{v[i]}'))" for k, v in COMMON.items()) + " ELSE 0 END"
    sums = ", ".join(f"CAST(sum({x}) AS BIGINT) AS r_{x}" for x in [*CHARS, *WORDS, "n_chars", "n_words"])
    return f"""
WITH d AS (SELECT doc_id, CASE WHEN lang IN ({', '.join(map(repr, COMMON))}) THEN lang ELSE 'other' END AS language, coalesce(text, '') AS text FROM {source}),
w0 AS (SELECT *, row_number() OVER () AS row_no, regexp_extract_all(text, '{ws}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{ws}')) AS lines FROM d),
tri AS (SELECT row_no, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT row_no, w, unnest(range(1, len(w) - 1)) AS i FROM w0)),
rep AS (SELECT row_no, count(DISTINCT p) AS n_repeat_words FROM (SELECT row_no, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY row_no, g) AS c FROM tri) WHERE c > 1) GROUP BY row_no),
c0 AS (SELECT doc_id, language, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {out('[#*$%&|<>]')} AS n_symbols,
 len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(text) AS n_chars,
 {out('[a-z]')} AS c_lower, {out('[A-Z]')} AS c_upper, {out('[0-9]')} AS c_digit, {out(r'[ \t\n\x0B\x0C\r]')} AS c_space, {out('[.,;:!?()"-]')} AS c_punct, {out(r'[^\x00-\x7F]')} AS c_other,
 {', '.join(f'{word(i)} AS k{i}' for i in range(K))} FROM w0 LEFT JOIN rep USING (row_no)),
c AS (SELECT * EXCLUDE (w), n_chars - c_lower - c_upper - c_digit - c_space - c_punct - c_other AS c_symbol, n_words - {' - '.join(f'k{i}' for i in range(K))} AS k_rest FROM c0),
r AS (SELECT language, {sums} FROM c GROUP BY language)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
 {BASE_FAILED} AS base_failed, NOT {BASE_FAILED} AND NOT {DIVERGES} AS kept FROM c JOIN r USING (language)"""


SQL = _sql()
