"""Stems of English words: the published Porter2 (Snowball English) algorithm."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_V, _C = "[aeiouy]", "[^aeiouy]"
_REGION = re.compile(f".*?{_V}{_C}")
_FIRST = re.compile("gener|commun|arsen")
_SHORT = re.compile(f"(?:.*{_C}|){_V}[^aeiouywxY]|{_V}{_C}")
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_WHOLE |= {w: w for w in "sky news howe atlas cosmos bias andes".split()}
_KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()


def _after(word: str, start: int) -> int:
    m = _REGION.match(word, start)
    return m.end() if m else len(word)


def _ending(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words with digits stay."""
    if len(word) < 3 or not word.isalpha():
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = re.sub(f"^y|(?<={_V})y", "Y", word)
    first = _FIRST.match(w)
    r1 = first.end() if first else _after(w, 0)
    r2 = _after(w, r1)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_V, w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    # 1b
    e = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and re.search(_V, w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT.fullmatch(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # 2
    e = _ending(w, _STEP2)
    if e and len(w) - len(e) >= r1:
        before = w[: -len(e)]
        if not (e == "ogi" and not before.endswith("l")) and not (e == "li" and before[-1:] not in tuple("cdeghkmnrt")):
            w = before + _STEP2[e]
    # 3
    e = _ending(w, _STEP3)
    if e and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = w[: -len(e)] + _STEP3[e]
    # 4
    e = _ending(w, _STEP4)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(e)]
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.fullmatch(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(ArrayType(StringType()))
def stems(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The stems of the words of each row, in order."""
    for s in words:
        yield s.map(lambda x: None if x is None else [stem(w) for w in x])
