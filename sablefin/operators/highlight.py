"""Marked terms in text, for the few rows that are shown."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sablefin.plans import ast as A


def query_terms(query: A.Query, field: str) -> list[str]:
    """The terms a query names for a field, clauses that exclude left out."""
    out: list[str] = []

    def visit(q) -> None:
        if isinstance(q, A.Bool):
            for x in (*q.must, *q.should, *q.filter):
                visit(x)
        elif isinstance(q, (A.Constant, A.Boosted)):
            visit(q.query)
        elif isinstance(q, A.Advanced):
            visit(q.core)
        elif isinstance(q, A.SpanNear):
            for x in q.clauses:
                visit(x)
        elif isinstance(q, A.SpanContaining):
            visit(q.big)
        elif isinstance(q, A.SpanWithin):
            visit(q.include)
        elif isinstance(q, A.MultiField) and field in q.fields:
            out.extend(re.findall(r"\w+", q.text.lower()))
        elif getattr(q, "field", None) == field:
            out.extend(getattr(q, "terms", None) or [x for x in (getattr(q, "term", None),) if x])

    visit(query)
    return sorted(set(out))


def alternatives(terms: list[str]) -> str:
    quoted = [re.sub(r"([^\w\s])", r"\\\1", t) for t in sorted(terms, key=lambda t: (-len(t), t))]
    return "|".join(quoted)


def highlight_terms(text: Column, terms: list[str], tag: str = "mark") -> Column:
    """Whole words, in any case, in one pass; the longest term wins."""
    if not terms:
        return text
    return F.regexp_replace(text, rf"(?iU)\b({alternatives(terms)})\b", f"<{tag}>$1</{tag}>")


def marked_snippet(text: Column, terms: list[str], length: int = 150) -> Column:
    """A window with a third of it before the first match, ellipses where it cuts."""
    found = F.array(*[F.locate(t.lower(), F.lower(text)) for t in terms]) if terms else F.array(F.lit(0))
    first = F.coalesce(F.array_min(F.filter(found, lambda p: p > 0)), F.lit(1))
    n = F.length(text)
    start = F.greatest(F.lit(1), F.least(first - length // 3, n - length + 1))
    end = F.least(n, start + length - 1)
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, end - start + 1), F.when(end < n, "...").otherwise(""))
    return F.when(n <= length, text).otherwise(cut)


def fragments_of(text: str, terms: set[str], size: int = 150, most: int = 5, tag: str = "mark") -> list[tuple[str, float]]:
    """The best fragments of a text and their scores.

    Matches whose windows (half a size to each side, moved out to word ends) touch share a fragment. A
    fragment's score is the mean over its matches of 1 + log2(length)/10 + 1/sqrt(number of terms).
    """
    found = [m for m in re.finditer(r"\w+", text) if m[0].lower() in terms]
    windows: list[list] = []
    for m in found:
        a, b = max(0, m.start() - size // 2), min(len(text), m.end() + size // 2)
        while a > 0 and text[a - 1].isalnum() and text[a : a + 1].isalnum():
            a -= 1
        while b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
            b += 1
        if windows and a <= windows[-1][1] and b - windows[-1][0] <= 2 * size:
            windows[-1][1] = b
            windows[-1][2].append(m)
        else:
            windows.append([a, b, [m]])
    out = []
    for a, b, ms in windows:
        made, at = "", a
        for m in ms:
            made += text[at : m.start()] + f"<{tag}>{m[0]}</{tag}>"
            at = m.end()
        score = sum(1 + 0.1 * math.log2(len(m[0])) + 1 / math.sqrt(len(terms)) for m in ms) / len(ms)
        out.append((made + text[at:b], score))
    return sorted(out, key=lambda x: -x[1])[:most]


def highlight_fragments(text: Column, terms: list[str], size: int = 150, most: int = 5, tag: str = "mark") -> Column:
    """Fragments as an array of structs; an Arrow UDF, for rows after the limit."""
    wanted = {t.lower() for t in terms}

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None or not wanted else [{"fragment": f, "score": s} for f, s in fragments_of(t, wanted, size, most, tag)])

    return F.pandas_udf(run, "array<struct<fragment:string,score:double>>")(text)


def best_fragment(fragments: Column) -> Column:
    return F.get(fragments, F.lit(0))["fragment"]


def combined(fragments: Column, between: str = " ... ") -> Column:
    return F.array_join(F.transform(fragments, lambda f: f["fragment"]), between)
