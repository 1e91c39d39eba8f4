"""Scores as Column expressions, and a registry of scoring functions by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, IDF_FLOOR = 1.2, 0.75, 0.01


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def idf(n, df, floor: float | None = IDF_FLOOR) -> Column:
    raw = F.log((_c(n) - _c(df) + 0.5) / (_c(df) + 0.5))
    return raw if floor is None else F.coalesce(F.greatest(raw, F.lit(floor)), F.lit(floor))


def saturated(tf, length, avg, k1: float = K1, b: float = B) -> Column:
    norm = F.when(_c(avg) > 0, 1 - b + b * F.coalesce(_c(length), _c(avg)) / _c(avg)).otherwise(F.lit(1.0))
    return _c(tf) * (k1 + 1) / (_c(tf) + k1 * norm)


def bm25(tf, length, avg, n, df, boost: float = 1.0, floor: float | None = IDF_FLOOR, k1: float = K1, b: float = B) -> Column:
    some = (_c(tf) > 0) & (_c(df) > 0) & (_c(n) > 0)
    return F.when(some, F.lit(float(boost)) * idf(n, df, floor) * saturated(tf, length, avg, k1, b)).otherwise(F.lit(0.0))


def tf_idf(tf, length, avg, n, df, boost: float = 1.0) -> Column:
    return (1 + F.log(_c(tf))) * boost * F.log(_c(n) / _c(df)) * F.sqrt(_c(avg) / _c(length))


def phrase(freq, n, matched, terms: int, boost: float = 1.0) -> Column:
    """Phrases weigh more than words: a higher idf and frequency, and more with every further term; no length norm."""
    rare = F.greatest(F.log((_c(n) - _c(matched) + 0.5) / (_c(matched) + 0.5)) + 0.1, F.lit(0.1)) * 1.2
    f = 1.5 * _c(freq)
    return F.lit(boost * (1 + 0.2 * (terms - 1))) * rare * f * (K1 + 1) / (f + K1)


def range_score(value: Column, low: float | None, high: float | None, n, matched, boost: float = 1.0) -> Column:
    """Rarity of the range times closeness of the value to its middle, or to its only bound."""
    width = abs(high - low) if low is not None and high is not None else None if low is None and high is None else 1000.0
    factor = 1 + min(100 / (width + 1), 2) if width else 1.0
    raw = F.log((_c(n) - _c(matched) + 0.5) / (_c(matched) + 0.5))
    base = F.when(raw.isNull() | F.isnan(raw) | (raw < 0), F.lit(0.5)).otherwise(raw)
    rare = F.when(_c(matched) > 0, F.greatest(F.lit(0.5), base * factor)).otherwise(F.lit(1.0))
    if low is not None and high is not None:
        middle, half = (low + high) / 2, (high - low) / 2
        near = 1 + F.greatest(F.lit(0.0), 1 - F.abs(value - middle) / half) if half > 0 else F.lit(1.0)
    elif low is None and high is None:
        near = F.lit(1.0)
    else:
        near = 1 + F.least(1 / (F.abs(value - (high if low is None else low)) + 1), F.lit(1.0))
    return boost * rare * F.when(value == 0, F.lit(1.5)).otherwise(near)


def pattern_complexity(pattern: str) -> float:
    """How telling a wildcard pattern is, 0.1 to 2."""
    wild = sum(c in "*?" for c in pattern)
    literal = len(pattern) - wild
    out = 0.7 if pattern.startswith("*") else 1.2 if pattern.endswith("*") and wild == 1 else 1.0
    out *= (1 + 0.1 * literal) * (1 - 0.05 * wild)
    return min(2.0, max(0.1, out * (1.5 if not wild else 1.0)))


def wildcard_score(tf, n, df, ctf, pattern: str, boost: float = 1.0) -> Column:
    rare = F.greatest(F.log((_c(n) - _c(df) + 0.5) / (_c(df) + 0.5)), F.lit(0.1))
    telling = F.greatest(F.log(_c(n) / _c(df)), F.lit(0.1))
    return boost * rare * telling * (_c(tf) * (K1 + 1) / (_c(tf) + K1)) * pattern_complexity(pattern) * (1 + 0.1 * _c(ctf) / _c(df))


def vector_space(weights: Column) -> Column:
    """Cosine of a vector of ones and a document's tf-idf weights, one weight for each query term (absent: 0)."""
    dot = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    norm = F.sqrt(F.aggregate(weights, F.lit(0.0), lambda a, w: a + w * w))
    return F.when(norm > 0, dot / (norm * F.sqrt(F.size(weights)))).otherwise(F.lit(0.0))


def coordination(matched: Column, terms: int) -> Column:
    return matched / F.lit(float(max(1, terms)))


def field_boost_factor(boosts: dict[str, float], matched_fields: Column) -> Column:
    """(1 + sum of boosts of fields that matched) / sum of all boosts."""
    total = sum(boosts.values()) or 1.0
    got = sum((F.when(F.array_contains(matched_fields, f), F.lit(b)).otherwise(F.lit(0.0)) for f, b in boosts.items()), F.lit(0.0))
    return (1 + got) / total


@dataclass(frozen=True)
class Stats:
    """Columns a scoring function may use."""

    tf: Column
    length: Column
    avg: Column
    n: Column
    df: Column
    boost: float = 1.0


ScoringFunction = Callable[[Stats], Column]
REGISTRY: dict[str, ScoringFunction] = {
    "bm25": lambda s: bm25(s.tf, s.length, s.avg, s.n, s.df, s.boost),
    "bm25_raw": lambda s: bm25(s.tf, s.length, s.avg, s.n, s.df, s.boost, floor=None),
    "tf_idf": lambda s: tf_idf(s.tf, s.length, s.avg, s.n, s.df, s.boost),
    "constant": lambda s: F.lit(float(s.boost)),
}


def register(name: str, function: ScoringFunction) -> None:
    REGISTRY[name] = function


def explained(s: Stats) -> Column:
    """The parts of a BM25 score."""
    return F.struct(idf(s.n, s.df).alias("idf"), saturated(s.tf, s.length, s.avg).alias("tf"), F.lit(s.boost).alias("boost"))
