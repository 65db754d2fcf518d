"""Stems of English words by the published suffix rules with two regions (K1): R1 begins behind the first consonant that
follows a vowel, R2 is the same within R1; a suffix goes or changes only where its region holds it."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: words with a stem of their own, words that stay, words that stay after the plural's step, beginnings of R1
OWN = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STAY = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
PREFIX = re.compile("(?:gener|commun|arsen)")
REGION = re.compile("[aeiouy][^aeiouy]")
SHORT = re.compile(r"(?:^|[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")
# fixed values: suffixes and what takes their place, in R1, then in R1 again, then in R2
LONG = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
MIDDLE = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": "", "ative": ""}
LAST = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_AFTER = set("cdeghkmnrt")


def regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    def behind(at: int) -> int:
        found = REGION.search(word, at)
        return found.end() if found else len(word)

    special = PREFIX.match(word)
    first = special.end() if special else behind(0)
    return first, behind(first)


def ending(word: str, suffixes) -> str:
    """The longest of the suffixes that the word ends with, "" if none."""
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def vowel_in(part: str) -> bool:
    return re.search("[aeiouy]", part) is not None


def singular(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and vowel_in(w[:-2]):
        return w[:-1]
    return w


def without_tense(w: str, r1: int) -> str:
    end = ending(w, ("eedly", "eed", "ingly", "edly", "ing", "ed"))
    if end in ("eed", "eedly"):
        return w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    base = w[: -len(end)] if end else w
    if not end or not vowel_in(base):
        return w
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base.endswith(DOUBLE):
        return base[:-1]
    return base + "e" if len(base) <= r1 and SHORT.search(base) else base


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in OWN:
        return OWN[word]
    if len(word) < 3:
        return word
    w = re.sub("(^|[aeiouy])y", r"\1Y", word.lstrip("'"))
    r1, r2 = regions(w)
    w = singular(re.sub("'(?:s'?)?$", "", w))
    if w in STAY:
        return w
    w = without_tense(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    end = ending(w, LONG)
    if end and len(w) - len(end) >= r1 and (end != "ogi" or w.endswith("logi")) and (end != "li" or w[-3:-2] in LI_AFTER):
        w = w[: -len(end)] + LONG[end]
    end = ending(w, MIDDLE)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + MIDDLE[end]
    end = ending(w, LAST)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not SHORT.search(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stem_lists(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])


def stems(words: Column) -> Column:
    """Stems of an array of lower-case words; words repeat, so a worker keeps the latest ones' stems."""
    return F.pandas_udf(stem_lists, T.ArrayType(T.StringType()))(words)
