"""Language of a text by scripts and function words, in built-in functions.

A text in another script than Latin is told by its script, a Latin one by which language's function words it has most of.
Confidence is the lead of the best language over the next, as a share of the best. No trigram tables: those of the usual
detectors are large and not ours; the README gives the accuracy measured on the test corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of languages in Latin script.
WORDS = {
    "en": "the of and to in is that it for was on are with as by this be from at or an which not have has",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se avec il sont",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero",
    "it": "di e il la che in a per un è del non della le si con i da una sono nel al come più gli",
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele",
    "nl": "de van een het en in is dat op te zijn voor met die niet aan er om ook als dan maar door bij",
    "sv": "och i att det som en på är av för med till den har de inte om ett han men var jag sig från",
    "da": "og i at det som en på er af for med til den har de ikke om et han men var jeg sig fra",
    "pl": "i w na z do nie się że jest to o jak za po od przez dla są co ale czy oraz tym jego",
    "tr": "ve bir bu da de için ile olarak olan en çok daha gibi ne var kadar ama sonra her o ki ya",
    "fi": "ja on ei se että oli hän mutta niin kun joka myös kuin tai ovat sen mukaan vain jos mitä",
}
# The script that each other language is told by.
SCRIPTS = {
    "ja": r"[぀-ヿ]", "ko": r"[가-힯]", "zh": r"[一-鿿]", "uk": r"[іїєґІЇЄҐ]", "ru": r"[Ѐ-ӿ]", "ar": r"[؀-ۿ]",
    "he": r"[֐-׿]", "el": r"[Ͱ-Ͽ]", "th": r"[฀-๿]", "hi": r"[ऀ-ॿ]",
}
# Characters before those of all SCRIPTS.
LATIN = r"[\x00-\u036F]+"
# Three-letter codes by two-letter ones.
THREE = {"en": "eng", "es": "spa", "de": "deu", "fr": "fra", "zh": "cmn", "ru": "rus", "pt": "por", "it": "ita", "nl": "nld", "ar": "arb", "ja": "jpn", "ko": "kor"}
# Two-letter codes by three-letter ones; others are undetermined.
TWO = {
    "eng": "en", "deu": "de", "fra": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "rus": "ru", "cmn": "zh", "jpn": "ja", "kor": "ko", "ara": "ar", "hin": "hi", "tur": "tr",
    "pol": "pl", "swe": "sv", "dan": "da", "fin": "fi", "nob": "no", "ukr": "uk", "heb": "he", "ces": "cs", "ron": "ro", "hun": "hu", "ell": "el", "tha": "th", "vie": "vi", "ind": "id",
}
KINDS = ("paragraph", "title", "heading", "quote", "list_item")
SAMPLE, LEAST = 1000, 20


def three_letters(tag: Column) -> Column:
    """The three-letter code of a two-letter one; others as they are."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in THREE.items() for x in p]), tag), tag)


def two_letters(code: Column) -> Column:
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in TWO.items() for x in p]), code), F.lit("und")))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def detect(text: Column) -> Column:
    """struct(language, confidence); both null where nothing tells."""
    return _bound(text, _detected)


def _detected(text: Column) -> Column:
    known = sorted({w for v in WORDS.values() for w in v.split()})
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w.isin(known))
    return _bound(words, lambda w: _bound(F.regexp_replace(text, LATIN, ""), lambda rest: _best(rest, w)))


def _best(rest: Column, words: Column) -> Column:
    """Of the characters behind Latin script and of the function words of any language."""
    among = lambda known: F.size(F.filter(words, lambda w: w.isin(known))).cast("double")
    counted = [F.struct(among(v.split()).alias("n"), F.lit(k).alias("k")) for k, v in WORDS.items()]
    # letters of other scripts weigh more than Latin words: they are counted as a word each
    counted += [F.struct((F.char_length(rest) - F.char_length(F.regexp_replace(rest, p, ""))).cast("double").alias("n"), F.lit(k).alias("k")) for k, p in SCRIPTS.items()]
    return _bound(F.sort_array(F.array(*counted), asc=False), lambda b: F.when(b[0]["n"] > 0, F.struct(b[0]["k"].alias("language"), ((b[0]["n"] - b[1]["n"]) / b[0]["n"]).alias("confidence"))))


def of_documents(elements: DataFrame, confidence: float = 0.5) -> DataFrame:
    """(doc_id, language, language_confidence) by the first SAMPLE bytes of the paragraphs, titles and headings of each document; null under the confidence."""
    t = elements.where(F.col("kind").isin("paragraph", "title", "heading"))
    # only what can reach the sample is gathered: running length before the element
    d = t.groupBy("doc_id").agg(F.expr(f"aggregate(transform(array_sort(collect_list(struct(pos, text))), x -> x.text), '', (s, x) -> if(octet_length(s) >= {SAMPLE}, s, if(s = '', x, concat(s, ' ', x))))").alias("s"))
    d = d.withColumn("x", detect(F.make_valid_utf8(F.substring(F.encode("s", "utf-8"), 1, SAMPLE).cast("string"))))
    sure = F.col("x.confidence") >= confidence
    return d.select("doc_id", F.when(sure, F.col("x.language")).alias("language"), F.when(sure, F.round("x.confidence", 4)).alias("language_confidence"))


def of_elements(elements: DataFrame, confidence: float = 0.5) -> DataFrame:
    """elements with language and language_confidence, of text kinds of LEAST bytes and more."""
    e = elements.withColumn("_x", F.when(F.col("kind").isin(*KINDS) & (F.octet_length("text") >= LEAST), detect(F.col("text"))))
    sure = F.col("_x.confidence") >= confidence
    return e.withColumn("language", F.when(sure, F.col("_x.language"))).withColumn("language_confidence", F.when(sure, F.round("_x.confidence", 4))).drop("_x")


def filtered(text: Column, target: str = "en", policy: str = "drop") -> Column:
    """The text, or an empty one if it has LEAST bytes and another language is told; the policy `flag` keeps all."""
    if policy == "flag":
        return text
    other = lambda t: F.coalesce(detect(t)["language"] != target, F.lit(False))
    return _bound(text, lambda t: F.when((F.octet_length(t) >= LEAST) & other(t), "").otherwise(t))
