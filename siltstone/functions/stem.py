"""English stemming by the published Porter2 algorithm, over arrays of words in Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the algorithm: exceptions, doubled consonants, endings.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
_V = "[aeiouy]"
_REGION = re.compile(rf"^.*?{_V}[^aeiouy]")
_SHORT_END = re.compile(rf"(?:[^aeiouy]{_V}[^aeiouywxY]|^{_V}[^aeiouy])$")


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    fixed = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    one = fixed if fixed is not None else (m.end() if (m := _REGION.match(w)) else len(w))
    return one, one + m.end() if (m := _REGION.match(w[one:])) else len(w)


@lru_cache(200_000)
def stem(word: str) -> str:
    w = word.lstrip("'")
    if len(w) < 3:
        return w
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    if w in UNCHANGED:
        return w
    # y as a consonant is Y
    w = re.sub(r"^y", "Y", w)
    w = re.sub(r"([aeiouy])y", r"\1Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"'s?'?$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(rf"{_V}.+s$", w):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    # 1b
    if m := re.search(r"eed(?:ly)?$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search(r"(?:ing|ed)(?:ly)?$", w)) and re.search(_V, w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT_END.search(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # 2
    for end in sorted([*STEP2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1:
                if end == "ogi":
                    w = w[:-1] if w[at - 1 : at] == "l" else w
                elif end == "li":
                    w = w[:-2] if w[at - 1 : at] in "cdeghkmnrt" and at else w
                else:
                    w = w[:at] + STEP2[end]
            break
    # 3
    for end in sorted([*STEP3, "ative"], key=len, reverse=True):
        if w.endswith(end):
            at = len(w) - len(end)
            if end == "ative":
                w = w[:at] if at >= r2 else w
            elif at >= r1:
                w = w[:at] + STEP3[end]
            break
    # 4
    for end in sorted([*STEP4, "ion"], key=len, reverse=True):
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stemmed(words: Column) -> Column:
    """An array of lower-cased words, each stemmed."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return run(words)


def stem_of(word: Column) -> Column:
    """The stem of a lower-cased word. For distinct words: a table's words are far more than its vocabulary."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(stem, na_action="ignore")

    return run(word)
