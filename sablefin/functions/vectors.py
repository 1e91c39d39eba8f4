"""Distances, similarities and normal forms of array columns."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the metrics.
METRICS = {
    "cosine": "cosine", "euclidean": "euclidean", "l2": "euclidean", "manhattan": "manhattan", "l1": "manhattan",
    "dot_product": "dot", "dot": "dot", "angular": "angular",
}


def metric(name: str) -> str:
    if name.lower() not in METRICS:
        raise ValueError(f"no such metric: {name}")
    return METRICS[name.lower()]


def lit_vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(double(a), double(b), lambda x, y: x * y))


def magnitude(a: Column) -> Column:
    return F.sqrt(total(F.transform(double(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    n = magnitude(a) * magnitude(b)
    return F.when(n > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def distance(a: Column, b: Column, name: str = "cosine") -> Column:
    kind = metric(name)
    if kind == "cosine":
        return F.coalesce(1 - cosine(a, b), F.lit(1.0))
    if kind == "angular":
        return F.coalesce(F.acos(cosine(a, b)), F.lit(math.pi))
    if kind == "dot":
        return -dot(a, b)
    gaps = F.zip_with(double(a), double(b), lambda x, y: x - y)
    return F.sqrt(total(F.transform(gaps, lambda d: d * d))) if kind == "euclidean" else total(F.transform(gaps, F.abs))


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def similarity_of(d: Column, name: str = "cosine") -> Column:
    """A distance as a similarity, 0 to 1."""
    kind = metric(name)
    return clamp(1 - d if kind == "cosine" else -d if kind == "dot" else 1 - d / math.pi if kind == "angular" else F.exp(-d))


def similarity(a: Column, b: Column, name: str = "cosine") -> Column:
    return similarity_of(distance(a, b, name), name)


def weighted_cosine(a: Column, b: Column, weights: Column) -> Column:
    root = F.transform(double(weights), F.sqrt)
    scaled = lambda v: F.zip_with(double(v), root, lambda x, w: x * w)
    return clamp(F.coalesce(cosine(scaled(a), scaled(b)), F.lit(0.0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of positive components."""
    both = total(F.zip_with(double(a), double(b), lambda x, y: F.when((x > 0) & (y > 0), 1.0).otherwise(0.0)))
    some = total(F.zip_with(double(a), double(b), lambda x, y: F.when((x > 0) | (y > 0), 1.0).otherwise(0.0)))
    return F.when(some == 0, F.lit(1.0)).otherwise(both / some)


def tanimoto(a: Column, b: Column) -> Column:
    d = dot(a, b)
    below = dot(a, a) + dot(b, b) - d
    return clamp(F.when(below == 0, F.lit(1.0)).otherwise(d / below))


def pearson(a: Column, b: Column) -> Column:
    """Correlation moved to 0..1; 0 where a variance is zero."""
    centred = lambda v: F.transform(double(v), lambda x: x - total(double(v)) / F.size(v))
    n = magnitude(centred(a)) * magnitude(centred(b))
    return clamp(F.when(n == 0, F.lit(0.0)).otherwise((dot(centred(a), centred(b)) / n + 1) / 2))


def ranks(v: Column) -> Column:
    """Place of each component in ascending order, earlier components first among equals."""
    order = F.transform(F.array_sort(F.transform(double(v), lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda s: s["i"])
    return F.transform(double(v), lambda _, i: (F.array_position(order, i) - 1).cast("double"))


def spearman(a: Column, b: Column) -> Column:
    return pearson(ranks(a), ranks(b))


def combined(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of similarities."""
    return sum((c * w for c, w in parts), F.lit(0.0)) / sum(w for _, w in parts)


def normalised(v: Column, form: str = "l2") -> Column:
    """l2, l1, minmax or none; a vector without spread or norm stays as it is."""
    v = double(v)
    if form == "none":
        return v
    if form == "minmax":
        low, high = F.array_min(v), F.array_max(v)
        return F.when(high > low, F.transform(v, lambda x: (x - low) / (high - low))).otherwise(v)
    n = magnitude(v) if form == "l2" else total(F.transform(v, F.abs))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def valid(v: Column, dimension: int | None = None) -> Column:
    """Not empty, all finite, of the dimension."""
    right = (F.size(v) > 0) & F.forall(double(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(right & (F.size(v) == dimension) if dimension else right, F.lit(False))


def scorer(name: str = "cosine"):
    """A function of two matrices: similarities of each row of the first to each of the second. It goes to executors by value."""
    import numpy as np

    kind = metric(name)

    def run(x, held):
        if kind == "manhattan":
            return np.clip(np.exp(-np.abs(x[:, None, :] - held[None, :, :]).sum(axis=2)), 0, 1)
        inner = x @ held.T
        if kind == "dot":
            s = inner
        elif kind == "euclidean":
            s = np.exp(-np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (held * held).sum(1)[None, :] - 2 * inner)))
        else:
            norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(held, axis=1)[None, :]
            cos = np.clip(np.divide(inner, norms, out=np.zeros_like(inner), where=norms > 0), -1, 1)
            s = np.where(norms > 0, cos if kind == "cosine" else 1 - np.arccos(cos) / np.pi, 0.0)
        return np.clip(s, 0, 1)

    return run


def batch_similarity(vectors: Column, queries, name: str = "cosine") -> Column:
    """Similarities to all of a small matrix of query vectors in one matrix product a batch."""
    import numpy as np

    held, score = np.asarray(queries, np.float64), scorer(name)

    def run(batch: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, np.float64) for v in batch]) if len(batch) else np.zeros((0, held.shape[1]))
        return pd.Series(list(score(x, held)))

    return F.pandas_udf(run, "array<double>")(vectors)
