"""The Porter stemmer (Porter, "An algorithm for suffix stripping", 1980) with the usual later extensions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words whose stems the rules would miss; fixed values.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _kinds(word: str) -> str:
    """``c`` or ``v`` for each letter; y after a consonant is a vowel."""
    out = ""
    for k, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and k and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return _kinds(word).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _short(word: str) -> bool:
    """Whether the word ends consonant, vowel, consonant other than w, x, y; or is a vowel and a consonant."""
    kinds = _kinds(word)
    return kinds[-3:] == "cvc" and word[-1] not in "wxy" or kinds == "vc"


def _longest(word: str, rules, least: int):
    """``word`` by the longest rule whose suffix it has, if the measure before it exceeds ``least``."""
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            return base + new if _measure(base) > least else word
    return word


def stem(word: str) -> str:
    """The stem of ``word`` in lower case. Words of one or two letters stay as they are."""
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    # plurals
    if w.endswith("ies") and len(w) == 4:
        w = w[:-1]
    elif w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # -ed and -ing
    cut = False
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and "v" in _kinds(w[: -len(suffix)]):
                w, cut = w[: -len(suffix)], True
                break
    if cut:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w):
            w = w if w[-1] in "lsz" else w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    # y after a consonant that isn't the first letter
    if w.endswith("y") and len(w) > 2 and _kinds(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    # double suffixes; -alli is taken back first, so that what is left may match again
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        w = w[:-2]
    if w.endswith("logi") and _measure(w[:-3]) > 0:
        w = w[:-1]
    else:
        w = _longest(w, _STEP2, 0)
    w = _longest(w, _STEP3, 0)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _short(base):
            w = base
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def stem_words(words: pd.Series) -> pd.Series:
    """Stems of single words; each different word of a batch is worked out once."""
    known = {w: stem(w) for w in words.dropna().unique()}
    return words.map(known)


@F.pandas_udf(T.StringType())
def stem_phrases(phrases: pd.Series) -> pd.Series:
    """Phrases with every space-separated word replaced by its stem, single spaces between."""
    known: dict[str, str] = {}

    def one(phrase):
        if phrase is None:
            return None
        out = []
        for w in phrase.split():
            if w not in known:
                known[w] = stem(w)
            out.append(known[w])
        return " ".join(out)

    return phrases.map(one)
