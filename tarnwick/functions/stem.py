"""Word stems and folded accents for the index. A stemmer works word by word, so it is an Arrow-batched UDF over distinct words of a batch."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwick.functions import text as T

_VOWELS = frozenset("aeiou")
# Suffixes of the Porter algorithm's second, third and fourth step.
STEP_TWO = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_THREE = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_FOUR = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def _shape(word: str) -> str:
    """c and v for each letter; y after a consonant is a vowel."""
    out: list[str] = []
    for i, c in enumerate(word):
        out.append("v" if c in _VOWELS or c == "y" and i > 0 and out[-1] == "c" else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _shape(stem)))


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _swap(word: str, table: dict[str, str], least: int) -> str:
    end = max((s for s in table if word.endswith(s)), key=len, default="")
    return word[: len(word) - len(end)] + table[end] if end and _measure(word[: len(word) - len(end)]) > least else word


def porter(word: str) -> str:
    """Porter's stem of a lower-case English word; others are left as they are."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        end = next((e for e in ("ed", "ing") if word.endswith(e) and "v" in _shape(word[: -len(e)])), None)
        if end:
            word = word[: -len(end)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP_TWO, 0), STEP_THREE, 0)
    end = max((s for s in STEP_FOUR if word.endswith(s)), key=len, default="")
    if end and _measure(word[: -len(end)]) > 1 and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stemmed(c: Column) -> Column:
    """Words of a text, accents folded and stemmed: an analyzer for the index."""

    @F.pandas_udf("array<string>")
    def stems(rows: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        out = []
        for words in rows:
            here = [] if words is None else list(words)
            for w in here:
                if w not in known:
                    known[w] = porter(fold(w))
            out.append([known[w] for w in here])
        return pd.Series(out)

    return stems(T.words(c))


def doubled(c: Column) -> Column:
    """Words of the text and, after them, its morphemes: the index's own mixture, in which stemmed words count twice."""
    return F.concat(T.words(c), stemmed(c))
