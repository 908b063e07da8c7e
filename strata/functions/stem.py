"""English stemming by suffix stripping, as published by M. F. Porter in 1980, for indexes that ask for it."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_VOWELS = "aeiou"


def _shape(word: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in _VOWELS or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often consonants follow vowels."""
    return len(re.findall("v+c+", _shape(stem)))


def _ends_short(word: str) -> bool:
    """Consonant, vowel, consonant at the end, and the last is none of w, x and y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


# Fixed values of the published algorithm: suffix, what replaces it; the longest that matches is taken.
_STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
           "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(word: str, suffixes) -> str | None:
    if not word.endswith(tuple(suffixes)):  # most words, told in one call
        return None
    return max((s for s in suffixes if word.endswith(s)), key=len)


def _plural(word: str) -> str:
    s = _longest(word, ("sses", "ies", "ss", "s"))
    return word if s is None or s == "ss" else word[:-1] if s == "s" else word[:-2]


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) else word
    s = _longest(word, ("ed", "ing"))
    if s is None or "v" not in _shape(word[: -len(s)]):
        return word
    word = word[: -len(s)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
        return word[:-1]
    return word + "e" if _measure(word) == 1 and _ends_short(word) else word


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case English word; words of up to two letters, and others than a to z, are their own."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for steps in (_STEP_2, _STEP_3):
        s = _longest(word, steps)
        if s and _measure(word[: -len(s)]) > 0:
            word = word[: -len(s)] + steps[s]
    s = _longest(word, _STEP_4)
    if s and _measure(word[: -len(s)]) > 1 and (s != "ion" or word[-4] in "st"):
        word = word[: -len(s)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _ends_short(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@F.arrow_udf(StringType())
def stems(words: pa.Array) -> pa.Array:
    """The stem of each word of a column; meant for distinct terms. Null stays null."""
    return pa.array([None if w is None else stem(w) for w in words.to_pylist()], pa.string())
