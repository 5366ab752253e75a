"""Word-level partial ratio (STR-9) and stems, as pandas UDFs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words(text: str | None) -> list[str]:
    """STR-8 in Python."""
    return [w.strip(_STRIP).lower() for w in re.sub(r"[_\-]", " ", text or "").split()]


def ratio(a: list[str], b: list[str]) -> float:
    """200 * longest common subsequence / total length."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def partial_ratio(a: list[str], b: list[str]) -> float:
    """The best ratio of the shorter list with a window of the longer, windows at the ends may be shorter; 0 if one is empty."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, known = len(a), set(a)
    best = 0.0
    for i in range(1 - n, len(b)):
        window = b[max(0, i) : i + n]
        if known.isdisjoint(window):
            continue
        best = max(best, ratio(a, window))
        if best == 100.0:
            break
    return best


@F.pandas_udf(T.DoubleType())
def word_partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """STR-9 of two texts, 0 to 100."""
    return pd.Series([partial_ratio(words(x), words(y)) for x, y in zip(a, b)], dtype="float64")


# fixed values: words that carry no content
STOPWORDS = frozenset("a an and are as at be been by did do does for from had has have he her his how i in is it its me my no nor not of on or our she so than that the their them then there these they this those to was we were what when where which who whom why will with would you your".split())


def stem(word: str) -> str:
    """A light suffix stripper for English: plurals, -ing, -ed, -ly."""
    for suffix, least in (("sses", 5), ("ies", 5), ("ing", 6), ("edly", 7), ("ed", 5), ("ly", 5), ("es", 5), ("s", 4)):
        if word.endswith(suffix) and len(word) >= least and not word.endswith("ss"):
            return word[: -len(suffix)] + ("y" if suffix == "ies" else "ss" if suffix == "sses" else "")
    return word


def content_stems(text: str | None) -> list[str]:
    return sorted({stem(w) for w in words(text) if w and w not in STOPWORDS})


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(text: pd.Series) -> pd.Series:
    """The distinct stems of the words that carry content (FLT-16)."""
    return text.map(content_stems)
