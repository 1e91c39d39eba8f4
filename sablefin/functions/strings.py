"""Edit distances and small string functions."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def levenshtein(a: Column, b: Column, threshold: int | None = None) -> Column:
    """Edits between two strings; over the threshold: null."""
    if threshold is None:
        return F.levenshtein(a, b)
    d = F.levenshtein(a, b, threshold)
    return F.when(d >= 0, d)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


@dataclass(frozen=True)
class Matcher:
    """One word held against a column of candidates."""

    word: str

    def distance(self, candidate: Column) -> Column:
        return levenshtein(F.lit(self.word), candidate)

    def distance_within(self, candidate: Column, threshold: int) -> Column:
        """Null over the threshold."""
        return levenshtein(F.lit(self.word), candidate, threshold)

    def similarity(self, candidate: Column) -> Column:
        return levenshtein_ratio(F.lit(self.word), candidate)

    def matches(self, candidate: Column, most: int) -> Column:
        return self.distance_within(candidate, most).isNotNull()


def aligned(a: str, b: str, swaps: bool = False, price=lambda x, y: 1.0) -> float:
    """Cheapest alignment row by row: insertions and deletions cost 1, a substitution price(x, y), a swap of neighbours 1."""
    older: list[float] = []
    last = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        now = [float(i)]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, now[-1] + 1, last[j - 1] + (0 if x == y else price(x, y)))
            if swaps and i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, older[j - 2] + 1)
            now.append(best)
        older, last = last, now
    return last[-1]


def _pairs(one, kind: str):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)], dtype="object")

    return F.pandas_udf(run, kind)


def osa(a: Column, b: Column) -> Column:
    """Optimal string alignment: Levenshtein with swaps of neighbours, no part edited twice."""
    return _pairs(lambda x, y: int(aligned(x, y, swaps=True)), "int")(a, b)


# Neighbouring keys of a QWERTY keyboard.
NEAR_KEYS = {
    "q": "was", "w": "qeasd", "e": "wrsdf", "r": "etdfg", "t": "ryfgh", "y": "tughj", "u": "yihjk", "i": "uojkl", "o": "ipkl", "p": "ol",
    "a": "qwsz", "s": "adwezx", "d": "sferxc", "f": "dgrtcv", "g": "fhtyvb", "h": "gjyubn", "j": "hkuinm", "k": "jliom", "l": "kopm",
    "z": "asx", "x": "zcsd", "c": "xvdf", "v": "cbfg", "b": "vngh", "n": "bmhj", "m": "njkl",
}


def keyboard(a: Column, b: Column) -> Column:
    """Edit distance in which a neighbouring key costs half."""
    price = lambda x, y: 0.5 if y in NEAR_KEYS.get(x.lower(), "") else 1.0
    return _pairs(lambda x, y: aligned(x, y, price=price), "double")(a, b)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    return F.size(F.filter(same, lambda x: x))


def acronym_words(text: Column) -> Column:
    """Lower-case runs of letters longer than one: the words of a spelling corpus."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"\p{IsAlphabetic}+"), F.lit(0)), lambda w: F.length(w) > 1)
