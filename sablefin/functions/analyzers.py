"""Analyzers: character filters, a tokenizer and token filters compiled into one Column."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefin.functions import text as T


@dataclass(frozen=True)
class Analyzer:
    """Calling it turns a text Column into array<string>; a term's position is its place in that array."""

    tokenizer: Callable[[Column], Column]
    filters: tuple = ()
    char_filters: tuple = ()
    name: str = ""  # for those with Python functions, whose expression does not tell them apart

    def __call__(self, text: Column) -> Column:
        for f in self.char_filters:
            text = f(text)
        tokens = self.tokenizer(text)
        for f in self.filters:
            tokens = f(tokens)
        return tokens

    def terms(self, spark: SparkSession, text: str) -> list[str]:
        """Analysis of one query literal on the driver."""
        return spark.range(1).select(self(F.lit(text)).alias("t")).first()["t"] or []

    def with_filters(self, *more) -> Analyzer:
        return Analyzer(self.tokenizer, (*self.filters, *more), self.char_filters)


STANDARD = Analyzer(T.regex_tokenizer(), (T.lowercase, T.stop()))
STANDARD_KEEPING_STOP_WORDS = Analyzer(T.regex_tokenizer(), (T.lowercase,))
ENGLISH = STANDARD
SIMPLE = Analyzer(T.regex_tokenizer())
KEYWORD = Analyzer(T.whole_tokenizer)
NOOP = Analyzer(lambda text: F.array().cast("array<string>"))


def japanese() -> Analyzer:
    return Analyzer(T.cjk_tokenizer, (T.lowercase, T.stop(T.JAPANESE_STOP_WORDS)), (T.normalise_filter("NFKC"), T.iteration_mark_filter()), "japanese")


def named_analyzers() -> tuple[Analyzer, ...]:
    return (STANDARD, STANDARD_KEEPING_STOP_WORDS, SIMPLE, KEYWORD, NOOP, japanese())


def fingerprint(analyzer: Analyzer) -> str:
    """An analyzer's name, or a digest of the expression that it compiles to; lambda variables count by place, not by name."""
    if analyzer.name:
        return analyzer.name
    names: dict[str, str] = {}
    text = re.sub(r"\b[a-z]\w*_\d+\b", lambda m: names.setdefault(m[0], f"v{len(names)}"), str(analyzer(F.col("text"))))
    return hashlib.sha1(text.encode()).hexdigest()


@dataclass(frozen=True)
class PerField:
    """An analyzer by field, and one for the rest."""

    default: Analyzer = STANDARD
    by_field: Mapping[str, Analyzer] = field(default_factory=dict)

    def of(self, name: str) -> Analyzer:
        return self.by_field.get(name, self.default)


def analyse(docs: DataFrame, column: str, analyzer: Analyzer = STANDARD, key: str = "doc_id") -> DataFrame:
    """Each document's terms without an index: term, first position, count, field length."""
    tokens = docs.select(key, analyzer(F.col(column)).alias("terms"))
    rows = tokens.select(key, F.size("terms").alias("len"), F.posexplode("terms").alias("pos", "term"))
    return rows.groupBy(key, "term").agg(F.min("pos").alias("first_pos"), F.count("*").alias("tf"), F.first("len").alias("len"))
