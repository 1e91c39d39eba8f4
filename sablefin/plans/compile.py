"""Query trees to hits: DataFrame[doc_id, score], one row a document.

Counts that scores need (documents, matches) are one-row tables broadcast into the plan, so a compiled
query is one lazy plan. A boolean query is one union of its clauses and one aggregation by document,
whatever the number of clauses; term clauses of one field share one scan of the postings.
"""

from __future__ import annotations

import re
from datetime import timedelta
from functools import reduce, singledispatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablefin.functions import geo, scores, strings
from sablefin.functions import text as T
from sablefin.operators.index import Index
from sablefin.plans import ast as A


def one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """df with the columns of a one-row table beside each row."""
    return df.crossJoin(F.broadcast(row))


def empty(index: Index) -> DataFrame:
    return index.all_ids().select("doc_id", F.lit(0.0).alias("score")).filter(F.lit(False))


@singledispatch
def hits(query: A.Query, index: Index) -> DataFrame:
    raise TypeError(f"no such query: {query!r}")


@hits.register
def _(query: A.MatchAll, index: Index) -> DataFrame:
    return index.all_ids().select("doc_id", F.lit(float(query.boost)).alias("score"))


@hits.register
def _(query: A.MatchNone, index: Index) -> DataFrame:
    return empty(index)


@hits.register
def _(query: A.Term, index: Index) -> DataFrame:
    return term_hits(index, query.field, [(query.term, query.boost)]).select("doc_id", "score")


def term_hits(index: Index, field: str, terms: list[tuple[str, float]], scoring: str = "bm25") -> DataFrame:
    """(doc_id, number, score) for each of the terms, by their numbers in the list, from one scan."""
    names = sorted({t for t, _ in terms})
    wanted = (F.col("field") == field) & (F.col("term").isin(names) if len(names) > 1 else F.col("term") == names[0])
    found = index.postings.filter(wanted).select("doc_id", "term", "tf", "len")
    df = index.term_stats.filter(wanted).select("term", "df")
    found = one_row(found.join(F.broadcast(df), "term"), index.stats(field))  # at most one row a term asked for
    entries = F.lit(None)
    for name in names:
        own = F.array(*[F.struct(F.lit(i).alias("number"), F.lit(float(b)).alias("boost")) for i, (t, b) in enumerate(terms) if t == name])
        entries = F.when(F.col("term") == name, own).otherwise(entries) if len(names) > 1 else own
    rows = found.select("doc_id", "tf", "len", "avg", "n", "df", F.explode(entries).alias("x"))
    stats = scores.Stats(*[F.col(c) for c in ("tf", "len", "avg", "n", "df")])
    return rows.select("doc_id", F.col("x.number").alias("number"), (F.col("x.boost") * scores.REGISTRY[scoring](stats)).alias("score"))


@hits.register
def _(query: A.Bool, index: Index) -> DataFrame:
    kinds = [(k, q) for k in ("must", "should", "filter", "must_not") for q in getattr(query, k)]
    if not kinds:
        return empty(index)
    terms: dict[str, list] = {}
    parts: list[DataFrame] = []
    for kind, q in kinds:
        if type(q) is A.Term:
            terms.setdefault(q.field, []).append((kind, q))
        else:
            parts.append(hits(q, index).select("doc_id", F.lit(kind).alias("kind"), "score"))
    for name, own in terms.items():
        rows = term_hits(index, name, [(q.term, q.boost) for _, q in own])
        by = F.array(*[F.lit(k) for k, _ in own])
        parts.append(rows.select("doc_id", F.get(by, "number").alias("kind"), "score"))
    rows = reduce(DataFrame.unionAll, parts)
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    counted = F.col("kind").isin("must", "should")
    by_doc = rows.groupBy("doc_id").agg(F.sum(F.when(counted, F.col("score")).otherwise(F.lit(0.0))).alias("score"), *[count(k) for k in ("must", "should", "filter", "must_not")])
    if not (query.must or query.should or query.filter):
        return index.all_ids().join(by_doc.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(float(query.boost)).alias("score"))
    required = len(query.must) + len(query.filter)
    least = max(query.minimum_should_match, 0 if required else 1) if query.should else 0
    keep = (F.col("must") == len(query.must)) & (F.col("filter") == len(query.filter)) & (F.col("must_not") == 0) & (F.col("should") >= least)
    return by_doc.filter(keep).select("doc_id", (query.boost * F.col("score")).alias("score"))


@hits.register
def _(query: A.Phrase, index: Index) -> DataFrame:
    if not query.terms:
        return empty(index)
    found = phrase_freq(query, index)
    matched = found.agg(F.count("*").alias("matched"))
    rows = one_row(one_row(found, matched), index.stats(query.field))
    return rows.select("doc_id", scores.phrase(F.col("freq"), F.col("n"), F.col("matched"), len(query.terms), query.boost).alias("score"))


def position_lists(index: Index, field: str, terms: tuple[str, ...]) -> DataFrame:
    """doc_id and a map from term to positions, for documents with all the terms."""
    names = sorted(set(terms))
    rows = index.postings.filter((F.col("field") == field) & F.col("term").isin(names)).select("doc_id", "term", "positions")
    grouped = rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    return grouped.filter(F.size("at") == len(names))


def moved(positions: Column, back: int) -> Column:
    return F.transform(positions, lambda x: x - back)


def phrase_freq(query: A.Phrase, index: Index) -> DataFrame:
    """doc_id and freq: how many positions of the first term start the phrase."""
    lists = position_lists(index, query.field, query.terms)
    at = [F.element_at("at", F.lit(t)) for t in query.terms]
    if query.slop == 0:
        starts = [moved(p, i) for i, p in enumerate(at)]
        freq = F.size(reduce(F.array_intersect, starts))
    else:
        def step(now: Column, positions: Column) -> Column:
            following = F.filter(positions, lambda p: (p > now) & (p <= now + 1 + query.slop))
            return F.when(now < 0, now).otherwise(F.coalesce(F.get(following, F.lit(0)), F.lit(-1)))

        freq = F.size(F.filter(at[0], lambda s: F.aggregate(F.array(*at[1:]), s, step) >= 0)) if len(at) > 1 else F.size(at[0])
    return lists.select("doc_id", freq.alias("freq")).filter("freq > 0")


def expansions(query: A.Fuzzy, index: Index) -> DataFrame:
    """Vocabulary terms within the edits: term, df, edits; nearest, most frequent first."""
    n, k = len(query.term), query.max_edits
    term, wanted = F.col("term"), F.lit(query.term)
    near = (F.col("field") == query.field) & F.length("term").between(n - k, n + k)
    if query.prefix_length:
        near &= F.col("term").startswith(query.term[: query.prefix_length])
    words = index.term_stats.filter(near).select("term", "df")
    if query.transpositions:  # a swap is two plain edits at most: this filter stays in the JVM and leaves little for the UDF
        words = words.filter(F.levenshtein(term, wanted, 2 * k) >= 0).withColumn("edits", strings.osa(term, wanted))
    else:
        words = words.withColumn("edits", F.levenshtein(term, wanted))
    return words.filter(F.col("edits") <= k).orderBy("edits", F.desc("df"), "term").limit(query.max_expansions)


@hits.register
def _(query: A.Fuzzy, index: Index) -> DataFrame:
    near = expansions(query, index).collect()  # max_expansions rows; as literals they reach the scan
    if not near:
        return empty(index)
    words = index.spark.createDataFrame([tuple(r) for r in near], "term string, df long, edits int")
    found = index.postings.filter((F.col("field") == query.field) & F.col("term").isin(sorted(r["term"] for r in near)))
    found = found.select("doc_id", "term", "tf", "len").join(F.broadcast(words), "term")
    similar = F.greatest(1 - 0.2 * F.col("edits"), F.lit(0.0))
    rows = one_row(found, index.stats(query.field))
    score = similar * scores.bm25(F.col("tf"), F.col("len"), F.col("avg"), F.col("n"), F.col("df"), query.boost)
    return rows.groupBy("doc_id").agg(F.max(score).alias("score"))


def wildcard_regex(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
            continue
        out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        i += 1
    return f"^(?s:{out})$"


@hits.register
def _(query: A.Wildcard, index: Index) -> DataFrame:
    rx = wildcard_regex(query.pattern)
    tokens = T.whitespace_tokenizer(F.col(query.field).cast("string"))
    found = index.docs.select("doc_id", F.size(F.filter(tokens, lambda t: t.rlike(rx))).alias("tf")).filter("tf > 0")
    totals = found.agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))
    n = index.docs.agg(F.count("*").alias("n"))
    rows = one_row(one_row(found, totals), n)
    return rows.select("doc_id", scores.wildcard_score(F.col("tf"), F.col("n"), F.col("df"), F.col("ctf"), query.pattern, query.boost).alias("score"))


@hits.register
def _(query: A.Prefix, index: Index) -> DataFrame:
    """rewrite: constant, top_terms (each term by its own counts), blended (all by the highest df), boolean (all terms, no limit)."""
    wanted = (F.col("field") == query.field) & F.col("term").startswith(query.prefix)
    found = index.postings.filter(wanted).select("doc_id", "term", "tf", "len")
    if query.rewrite == "constant":
        return found.select("doc_id").distinct().select("doc_id", F.lit(float(query.boost)).alias("score"))
    words = index.term_stats.filter(wanted).select("term", "df")
    if query.rewrite != "boolean":
        words = F.broadcast(words.orderBy(F.desc("df"), "term").limit(query.max_expansions))
    found = found.join(words, "term")
    if query.rewrite == "blended":
        found = one_row(found.drop("df"), words.agg(F.max("df").alias("df")))
    rows = one_row(found, index.stats(query.field))
    score = scores.bm25(F.col("tf"), F.col("len"), F.col("avg"), F.col("n"), F.col("df"), query.boost)
    return rows.groupBy("doc_id").agg(F.sum(score).alias("score"))


def bounded(value: Column, q) -> Column:
    """The test of a range; an open end is no test."""
    test = value.isNotNull()
    if q.low is not None:
        test &= value >= F.lit(q.low) if q.include_low else value > F.lit(q.low)
    if q.high is not None:
        test &= value <= F.lit(q.high) if q.include_high else value < F.lit(q.high)
    return test


@hits.register
def _(query: A.NumericRange, index: Index) -> DataFrame:
    is_text = dict(index.docs.dtypes).get(query.field) == "string"
    value = F.expr(f"try_cast(`{query.field}` as double)") if is_text else F.col(query.field)
    found = index.docs.filter(bounded(value, query)).select("doc_id", value.cast("double").alias("value"))
    rows = one_row(one_row(found, found.agg(F.count("*").alias("matched"))), index.docs.agg(F.count("*").alias("n")))
    return rows.select("doc_id", scores.range_score(F.col("value"), query.low, query.high, F.col("n"), F.col("matched"), query.boost).alias("score"))


@hits.register
def _(query: A.StringRange, index: Index) -> DataFrame:
    rows = index.postings.filter((F.col("field") == query.field) & bounded(F.col("term"), query)).groupBy("doc_id").agg(F.sum("tf").alias("tf"), F.first("len").alias("len"))
    return estimated(rows, index, query.field, query.boost)


def estimated(rows: DataFrame, index: Index, field: str, boost: float) -> DataFrame:
    """BM25 over rows (doc_id, tf, len) that share one document frequency: their number."""
    rows = one_row(one_row(rows, rows.agg(F.count("*").alias("df"))), index.stats(field))
    return rows.select("doc_id", scores.bm25(F.col("tf"), F.col("len"), F.col("avg"), F.col("n"), F.col("df"), boost).alias("score"))


@hits.register
def _(query: A.DateTimeRange, index: Index) -> DataFrame:
    """Compared to the second, as bounds on the bare column, so that the scan can prune."""
    at, second = F.col(query.field), timedelta(seconds=1)
    low, high = (x if x is None else x.replace(microsecond=0) for x in (query.low, query.high))
    test = at.isNotNull()
    if low is not None:
        test &= at >= F.lit(low if query.include_low else low + second)
    if high is not None:
        test &= at < F.lit(high + second if query.include_high else high)
    found = index.docs.filter(test).select("doc_id")
    rows = one_row(one_row(found, found.agg(F.count("*").alias("df"))), index.docs.agg(F.count("*").alias("n")))
    return rows.select("doc_id", scores.bm25(1, 1, 1, F.col("n"), F.col("df"), query.boost).alias("score"))


def place(field: str) -> tuple[Column, Column]:
    return F.col(f"{field}.lat"), F.col(f"{field}.lon")


@hits.register
def _(query: A.GeoDistance, index: Index) -> DataFrame:
    lat, lon = place(query.field)
    near = index.docs.filter(geo.inside(lat, lon, *geo.around(query.lat, query.lon, query.km))).select("doc_id", geo.distance_km(lat, lon, query.lat, query.lon).alias("km"))
    score = F.when(F.col("km") == 0, F.lit(1.0)).otherwise(1 - F.col("km") / query.km) if query.km else F.lit(1.0)
    return near.filter(F.col("km") <= query.km).select("doc_id", (query.boost * score).alias("score"))


@hits.register
def _(query: A.GeoBox, index: Index) -> DataFrame:
    box = geo.Box(query.north, query.west, query.south, query.east)
    lat, lon = place(query.field)
    far = box.farthest_km
    score = (far - geo.distance_km(lat, lon, *box.centre)) / far if far else F.lit(1.0)
    return index.docs.filter(geo.inside(lat, lon, box.south, box.north, box.west, box.east)).select("doc_id", (query.boost * score).alias("score"))


# Spans: doc_id and an array of (s, e), e exclusive.


@singledispatch
def spans(query: A.Span, index: Index) -> DataFrame:
    raise TypeError(f"no such span query: {query!r}")


def span_field(query: A.Span) -> str:
    inner = getattr(query, "clauses", None) or (getattr(query, "big", None) or getattr(query, "include", None),)
    return query.field if isinstance(query, A.SpanTerm) else span_field(inner[0])


@spans.register
def _(query: A.SpanTerm, index: Index) -> DataFrame:
    return index.of_term(query.field, query.term).select("doc_id", F.transform("positions", lambda p: F.struct(p.alias("s"), (p + 1).alias("e"))).alias("spans"))


@spans.register
def _(query: A.SpanNear, index: Index) -> DataFrame:
    parts = [spans(c, index).withColumnRenamed("spans", f"c{i}") for i, c in enumerate(query.clauses)]
    rows = reduce(lambda a, b: a.join(b, "doc_id"), parts)
    plain = all(isinstance(c, A.SpanTerm) for c in query.clauses)
    made = F.transform("c0", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), (x["e"] - x["s"]).alias("words"), x["e"].alias("last")))
    def grown(i: int):
        """Each combination so far with each span of clause i that it may take."""

        def one(m: Column) -> Column:
            def fits(x: Column) -> Column:
                if query.in_order:
                    return (x["s"] >= m["last"]) & (x["e"] - m["s"] - m["words"] - (x["e"] - x["s"]) <= query.slop)
                apart = (x["s"] >= m["e"]) | (x["e"] <= m["s"]) if i == 1 else F.lit(True)
                return apart & (F.greatest(x["e"], m["e"]) - F.least(x["s"], m["s"]) <= query.slop + len(parts)) if plain else apart

            join = lambda x: F.struct(F.least(m["s"], x["s"]).alias("s"), F.greatest(m["e"], x["e"]).alias("e"), (m["words"] + x["e"] - x["s"]).alias("words"), x["e"].alias("last"))
            return F.transform(F.filter(f"c{i}", fits), join)

        return one

    for i in range(1, len(parts)):
        made = F.flatten(F.transform(made, grown(i)))
    good = F.filter(made, lambda m: (m["e"] - m["s"] - m["words"]).between(0, query.slop))
    out = F.array_sort(F.array_distinct(F.transform(good, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e")))))
    return rows.select("doc_id", out.alias("spans")).filter(F.size("spans") > 0)


@spans.register
def _(query: A.SpanContaining, index: Index) -> DataFrame:
    rows = spans(query.big, index).join(spans(query.little, index).withColumnRenamed("spans", "little"), "doc_id")
    kept = F.filter("spans", lambda b: F.exists("little", lambda x: (b["s"] <= x["s"]) & (x["e"] <= b["e"])))
    return rows.select("doc_id", kept.alias("spans")).filter(F.size("spans") > 0)


@spans.register
def _(query: A.SpanWithin, index: Index) -> DataFrame:
    rows = spans(query.include, index).join(spans(query.near, index).withColumnRenamed("spans", "near"), "doc_id")
    gap = lambda a, b: F.greatest(a["s"] - b["e"], b["s"] - a["e"], F.lit(0))
    kept = F.filter("spans", lambda a: F.exists("near", lambda b: gap(a, b) <= query.distance))
    return rows.select("doc_id", kept.alias("spans")).filter(F.size("spans") > 0)


@hits.register
def _(query: A.Span, index: Index) -> DataFrame:
    rows = spans(query, index).select("doc_id", F.size("spans").alias("tf"), F.lit(None).cast("int").alias("len"))
    return estimated(rows, index, span_field(query), query.boost)


# Composite queries


@hits.register
def _(query: A.Constant, index: Index) -> DataFrame:
    return hits(query.query, index).select("doc_id", F.lit(float(query.score)).alias("score"))


@hits.register
def _(query: A.Boosted, index: Index) -> DataFrame:
    return hits(query.query, index).select("doc_id", (F.col("score") * query.boost).alias("score"))


def reboosted(query: A.Query, boosts: dict) -> A.Query:
    """Term and phrase clauses with the boosts of their fields."""
    from dataclasses import replace

    if isinstance(query, A.Bool):
        return replace(query, **{k: tuple(reboosted(q, boosts) for q in getattr(query, k)) for k in ("must", "should")})
    name = getattr(query, "field", None)
    return replace(query, boost=query.boost * boosts[name]) if name in boosts else query


@hits.register
def _(query: A.Advanced, index: Index) -> DataFrame:
    found = hits(reboosted(query.core, query.field_boosts), index)
    for q in (*query.filters, *query.post_filters):
        found = found.join(hits(q, index).select("doc_id"), "doc_id", "left_semi")
    for q in query.negative_filters:
        found = found.join(hits(q, index).select("doc_id"), "doc_id", "left_anti")
    return found.select("doc_id", (F.col("score") * query.boost).alias("score")).filter(F.col("score") >= query.min_score)


@hits.register
def _(query: A.MultiField, index: Index) -> DataFrame:
    per: list[DataFrame] = []
    for name, boost in query.fields.items():
        terms = index.analyzers.of(name).terms(index.spark, query.text)
        if terms:
            per.append(term_hits(index, name, [(t, boost) for t in terms]).select("doc_id", "number", F.lit(name).alias("name"), "score"))
    if not per:
        return empty(index)
    rows = reduce(DataFrame.unionAll, per)
    if query.kind == "cross":  # each word by its best field, then summed
        word = rows.groupBy("doc_id", "number").agg(F.max("score").alias("best"), F.sum("score").alias("all"))
        out = word.groupBy("doc_id").agg(F.sum(F.col("best") + query.tie_breaker * (F.col("all") - F.col("best"))).alias("score"))
    else:
        one = rows.groupBy("doc_id", "name").agg(F.sum("score").alias("score"))
        if query.kind == "most":
            out = one.groupBy("doc_id").agg(F.sum("score").alias("score"), F.count("*").alias("fields")).filter(F.col("fields") == len(query.fields))
        elif query.kind == "best":
            out = one.groupBy("doc_id").agg((F.max("score") + query.tie_breaker * (F.sum("score") - F.max("score"))).alias("score"))
        elif query.kind == "boolean":
            out = one.groupBy("doc_id").agg(F.sum("score").alias("score"))
        else:
            raise ValueError(f"no such kind: {query.kind}")
    return out.select("doc_id", (F.col("score") * query.boost).alias("score"))


@hits.register
def _(query: A.MoreLikeThis, index: Index) -> DataFrame:
    """The given documents' most telling terms (tf times idf, summed over them) as a weighted query; the documents themselves are left out."""
    rows = index.postings.filter(F.col("field").isin(list(query.fields)))
    if query.text is not None:
        made = [(f, t) for f in query.fields for t in index.analyzers.of(f).terms(index.spark, query.text)]
        source = index.spark.createDataFrame(made, "field string, term string").groupBy("field", "term").agg(F.count("*").alias("tf"))
    else:
        source = reduce(DataFrame.unionAll, [index.terms_of(query.doc_ids, f).select(F.lit(f).alias("field"), "term", "tf") for f in query.fields])
    known = index.term_stats.join(F.broadcast(source.filter(F.col("tf") >= query.min_tf)), ["field", "term"]).filter(F.col("df") >= query.min_df)  # terms of the given texts only
    known = known.join(F.broadcast(index.field_stats.select("field", "n", F.col("avg_len").alias("avg"))), "field")
    weighed = known.withColumn("weight", F.col("tf") * scores.idf(F.col("n"), F.col("df"))).orderBy(F.desc("weight"), "field", "term").limit(query.max_terms)
    best = weighed.select("field", "term", "df", "n", "avg").collect()  # max_terms rows; as literals they reach the scan
    if not best:
        return empty(index)
    top = index.spark.createDataFrame([tuple(r) for r in best], "field string, term string, df long, n long, avg double")
    rows = rows.filter(F.col("term").isin(sorted({r["term"] for r in best})))
    found = rows.filter(~F.col("doc_id").isin(list(query.doc_ids))) if query.doc_ids else rows
    joined = found.join(F.broadcast(top), ["field", "term"])
    score = scores.bm25(F.col("tf"), F.col("len"), F.col("avg"), F.col("n"), F.col("df"), query.boost)
    return joined.groupBy("doc_id").agg(F.sum(score).alias("score"))
