"""Query nodes. Each is data only; compile.py turns it into hits."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime


@dataclass(frozen=True)
class Query:
    pass


@dataclass(frozen=True)
class MatchAll(Query):
    boost: float = 1.0


@dataclass(frozen=True)
class MatchNone(Query):
    pass


@dataclass(frozen=True)
class Term(Query):
    """An exact term, not analysed."""

    field: str
    term: str
    boost: float = 1.0


@dataclass(frozen=True)
class Phrase(Query):
    """Terms in order; each next one within slop + 1 positions of the one before, the first such position taken."""

    field: str
    terms: tuple[str, ...]
    slop: int = 0
    boost: float = 1.0


@dataclass(frozen=True)
class Bool(Query):
    must: tuple[Query, ...] = ()
    should: tuple[Query, ...] = ()
    must_not: tuple[Query, ...] = ()
    filter: tuple[Query, ...] = ()
    minimum_should_match: int = 0
    boost: float = 1.0


@dataclass(frozen=True)
class Fuzzy(Query):
    field: str
    term: str
    max_edits: int = 2
    prefix_length: int = 0
    transpositions: bool = True
    max_expansions: int = 50
    boost: float = 1.0


@dataclass(frozen=True)
class Wildcard(Query):
    """* and ? over white-space tokens of the stored text, case-sensitive; a backslash escapes."""

    field: str
    pattern: str
    boost: float = 1.0


@dataclass(frozen=True)
class Prefix(Query):
    field: str
    prefix: str
    max_expansions: int = 50
    rewrite: str = "constant"
    boost: float = 1.0


@dataclass(frozen=True)
class NumericRange(Query):
    field: str
    low: float | None = None
    high: float | None = None
    include_low: bool = True
    include_high: bool = True
    boost: float = 1.0


@dataclass(frozen=True)
class StringRange(Query):
    field: str
    low: str | None = None
    high: str | None = None
    include_low: bool = True
    include_high: bool = True
    boost: float = 1.0


@dataclass(frozen=True)
class DateTimeRange(Query):
    field: str
    low: datetime | None = None
    high: datetime | None = None
    include_low: bool = True
    include_high: bool = True
    boost: float = 1.0


@dataclass(frozen=True)
class GeoDistance(Query):
    field: str
    lat: float
    lon: float
    km: float
    boost: float = 1.0


@dataclass(frozen=True)
class GeoBox(Query):
    field: str
    north: float
    west: float
    south: float
    east: float
    boost: float = 1.0


@dataclass(frozen=True)
class Span(Query):
    """A query whose matches are word ranges; as a query its frequency is the number of them."""


@dataclass(frozen=True)
class SpanTerm(Span):
    field: str
    term: str
    boost: float = 1.0


@dataclass(frozen=True)
class SpanNear(Span):
    """One span of each clause with at most slop words between them in all."""

    clauses: tuple[Span, ...]
    slop: int = 0
    in_order: bool = True
    boost: float = 1.0


@dataclass(frozen=True)
class SpanContaining(Span):
    big: Span
    little: Span
    boost: float = 1.0


@dataclass(frozen=True)
class SpanWithin(Span):
    """Spans of include within a distance of some span of near."""

    include: Span
    near: Span
    distance: int = 0
    boost: float = 1.0


@dataclass(frozen=True)
class Constant(Query):
    query: Query
    score: float = 1.0


@dataclass(frozen=True)
class Boosted(Query):
    query: Query
    boost: float = 1.0


@dataclass(frozen=True)
class Advanced(Query):
    """Core query with filters before and after; filters give no score."""

    core: Query
    filters: tuple[Query, ...] = ()
    negative_filters: tuple[Query, ...] = ()
    post_filters: tuple[Query, ...] = ()
    field_boosts: dict = field(default_factory=dict, hash=False)
    min_score: float = 0.0
    boost: float = 1.0


@dataclass(frozen=True)
class MultiField(Query):
    """One text over many fields. best and cross: any field; most: all fields."""

    text: str
    fields: dict = field(hash=False)
    kind: str = "best"
    tie_breaker: float = 0.0
    boost: float = 1.0


@dataclass(frozen=True)
class MoreLikeThis(Query):
    fields: tuple[str, ...]
    doc_ids: tuple[int, ...] = ()
    text: str | None = None
    max_terms: int = 25
    min_tf: int = 1
    min_df: int = 1
    boost: float = 1.0


def phrase(spark, analyzer, field: str, text: str, slop: int = 0, boost: float = 1.0) -> Query:
    """An analysed phrase; one word is a term, none matches nothing."""
    words = tuple(analyzer.terms(spark, text))
    return Phrase(field, words, slop, boost) if len(words) > 1 else Term(field, words[0], boost) if words else MatchNone()


def span_phrase(field: str, words) -> SpanNear:
    return SpanNear(tuple(SpanTerm(field, w) for w in words), 0, True)


def span_proximity(field: str, words, slop: int) -> SpanNear:
    return SpanNear(tuple(SpanTerm(field, w) for w in words), slop, False)
