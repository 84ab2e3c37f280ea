"""Word and character n-grams, as columns and as Python values (the latter for scoring in Arrow batches)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"\b\w\w+\b")


def words(text: Column) -> Column:
    """Lower-cased runs of two word characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def word_ngrams(text: Column, low: int = 1, high: int = 3) -> Column:
    w = words(text)
    grams = {1: w}
    for n in range(2, high + 1):  # the grams before, joined with the words behind them
        count = F.greatest(F.size(w) - n + 1, F.lit(0))
        grams[n] = F.zip_with(F.slice(grams[n - 1], F.lit(1), count), F.slice(w, F.lit(n), count), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(*[grams[n] for n in range(low, high + 1)])


def char_ngrams(text: Column, low: int = 3, high: int = 6) -> Column:
    """n-grams within blank-padded words; a padded word shorter than n gives itself once."""
    padded = F.transform(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = lambda w, n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(w) - n + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))
    of = lambda w: F.concat(*[F.when((F.char_length(w) >= n) | F.lit(n == low), grams(w, n)).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)])
    return F.flatten(F.transform(padded, of))


def python_word_ngrams(text: str, low: int = 1, high: int = 3) -> list[str]:
    w = WORD.findall(text.lower())
    return [" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]


def python_char_ngrams(text: str, low: int = 3, high: int = 6) -> list[str]:
    out = []
    for w in text.lower().split():
        w = f" {w} "
        for n in range(low, high + 1):
            if len(w) >= n or n == low:
                out += [w[i : i + n] for i in range(max(1, len(w) - n + 1))]
    return out
