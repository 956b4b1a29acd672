"""The Porter stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980), as an Arrow UDF over arrays of words."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c for a consonant, v for a vowel; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[i - 1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _replace(word: str, rules: dict[str, str]) -> str:
    end = _longest(word, rules)
    base = word[: len(word) - len(end)]
    return base + rules[end] if end and _measure(base) > 0 else word


@lru_cache(1 << 16)
def porter(word: str) -> str:
    if len(word) < 3:
        return word
    # plurals and participles
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        end = "ed" if word.endswith("ed") else "ing" if word.endswith("ing") else ""
        base = word[: len(word) - len(end)]
        if end and "v" in _shape(base):
            if base.endswith(("at", "bl", "iz")):
                word = base + "e"
            elif len(base) > 1 and base[-1] == base[-2] and _shape(base)[-1] == "c" and base[-1] not in "lsz":
                word = base[:-1]
            else:
                word = base + "e" if _measure(base) == 1 and _short(base) else base
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, _STEP2), _STEP3)
    end = _longest(word, _STEP4)
    base = word[: len(word) - len(end)]
    if end and _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
        word = base
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short(base)):
            word = base
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@F.pandas_udf(ArrayType(StringType()))
def porter_stems(words: pd.Series) -> pd.Series:
    return words.map(lambda own: None if own is None else [porter(w) for w in own])
