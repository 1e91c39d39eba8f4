"""Embedders: text (or bytes) columns to vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder:
    """Subclasses give vectors for a batch of inputs; calling it makes a Column."""

    dimension: int

    def vectors(self, inputs: list) -> np.ndarray:
        raise NotImplementedError

    def __call__(self, column: Column) -> Column:
        def run(batch: pd.Series) -> pd.Series:
            some = [x for x in batch if x is not None]
            made = iter(self.vectors(some)) if some else iter(())
            return pd.Series([None if x is None else np.asarray(next(made), np.float32) for x in batch])

        return F.pandas_udf(run, "array<float>")(column)


@dataclass
class HashingEmbedder(Embedder):
    """Words hashed to signed buckets, then L2: deterministic, without a model."""

    dimension: int = 128

    def vectors(self, inputs: list) -> np.ndarray:
        out = np.zeros((len(inputs), self.dimension), np.float32)
        for row, text in enumerate(inputs):
            for word in (text.lower() if isinstance(text, str) else text.hex()).split():
                h = int.from_bytes(hashlib.md5(word.encode(), usedforsecurity=False).digest()[:8], "little")
                out[row, (h >> 1) % self.dimension] += 1 if h & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


@dataclass
class CallableEmbedder(Embedder):
    """Any function of a list of inputs: a local model or a service."""

    function: Callable
    dimension: int

    def vectors(self, inputs: list) -> np.ndarray:
        return np.asarray(self.function(inputs), np.float32)


class PrecomputedEmbedder(Embedder):
    """For vectors that come with the documents; embedding anything is an error."""

    dimension = 0

    def vectors(self, inputs: list) -> np.ndarray:
        raise ValueError("vectors are precomputed: pass them, not text")


@dataclass
class PerFieldEmbedder:
    default: Embedder
    by_field: Mapping[str, Embedder]

    def of(self, name: str) -> Embedder:
        return self.by_field.get(name, self.default)
