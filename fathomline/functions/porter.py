"""Analyzer with case and accent folding and Porter's stemmer (Porter, 1980), for indexes that want it."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_C, _V = "[^aeiou](?:[^aeiouy])*", "[aeiouy][aeiou]*"
_MEASURE = re.compile(f"^(?:{_C})?((?:{_V}{_C})*)(?:{_V})?$")
_VOWEL = re.compile(f"^(?:{_C})?{_V}")
_CVC = re.compile(f"^{_C}[aeiouy][^aeiouwxy]$")
_DOUBLE = re.compile(r"([^aeiouy])\1$")

# The suffix tables of steps 2 to 4.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _measure(stem: str) -> int:
    m = _MEASURE.match(stem)
    return len(re.findall(f"{_V}{_C}", m[1])) if m else 0


def _replaced(word: str, rules: list[tuple[str, str]]) -> str:
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            return base + new if _measure(base) > 0 else word
    return word


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    first_y = word[0] == "y"
    w = "Y" + word[1:] if first_y else word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    more = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _VOWEL.match(w[:-2]):
        w, more = w[:-2], True
    elif w.endswith("ing") and _VOWEL.match(w[:-3]):
        w, more = w[:-3], True
    if more:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE.search(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _CVC.match(w):
            w += "e"
    if w.endswith("y") and _VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, STEP2), STEP3)
    for suffix in sorted([*STEP4, "ion"], key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _CVC.match(base)):
            w = base
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return "y" + w[1:] if first_y else w


def analyse(text: str | None) -> list[str]:
    """Stems of the words of ``text``: lower case, marks removed, letters and digits only."""
    folded = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))
    return [stem(w) for w in re.findall(r"[^\W_]+", folded)]


@F.pandas_udf(ArrayType(StringType()))
def stems(text: pd.Series) -> pd.Series:
    return text.map(analyse)


def query_phrases(query: str, most: int = 20) -> list[list[str]]:
    """The items of a query, each as the stems that must stand next to one another."""
    items = re.findall(r"[\w-]+", query.casefold())
    if not items:
        raise ValueError("Search query must contain at least one word")
    return [analyse(i) for i in items[:most]]
