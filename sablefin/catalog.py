"""Named queries over the test tables, each with its equal in SQL where SQL can say it.

Scores are rounded to six decimals on both sides; ties go by id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefin.functions import geo, scores, strings
from sablefin.functions import synonyms as S
from sablefin.functions import text as T
from sablefin.functions import vectors as V
from sablefin.functions.analyzers import STANDARD, STANDARD_KEEPING_STOP_WORDS, Analyzer
from sablefin.operators import highlight, hybrid, knn, results, similar, spelling
from sablefin.operators.index import Index, build
from sablefin.plans import ast as A
from sablefin.plans.compile import hits, term_hits
from sablefin.sources import columns
from sablefin.streaming import ingest
from sablefin.engine import Engine
from sablefin.session import shared_dir
from sablefin.sources.store import Files, Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


OPEN: dict[tuple[str, str], Index] = {}


def saved(spark: SparkSession, sf: str, name: str, fields: list[str], key: str = "doc_id") -> Index:
    """The index of a table, built once and kept in the shared folder; a table whose files have changed gets another."""
    path = f"{sf}/{name}.parquet"
    files = Files(spark, path)
    status = files.fs.getFileStatus(files.path(path))
    parts = [status] if status.isFile() else list(files.fs.listStatus(files.path(path)))
    seen = [path, fields, sorted((p.getPath().getName(), p.getLen(), p.getModificationTime()) for p in parts)]
    at = f"{shared_dir(spark)}/index-{hashlib.sha1(repr(seen).encode()).hexdigest()}"
    if (spark.sparkContext.applicationId, at) not in OPEN:
        store = Store(spark, at)
        if not store.exists():
            store.save(build(table(spark, sf, name), fields, key=key))
        OPEN[spark.sparkContext.applicationId, at] = store.open()
    return OPEN[spark.sparkContext.applicationId, at]


def doc_index(spark: SparkSession, sf: str) -> Index:
    return saved(spark, sf, "documents", ["text"])


def part_index(spark: SparkSession, sf: str) -> Index:
    return saved(spark, sf, "part", ["p_name", "p_type"], key="p_partkey")


def rounded(found: DataFrame, *names: str) -> DataFrame:
    return found.withColumns({c: F.round(c, 6) for c in names or ("score",)})


def best(found: DataFrame, k: int = 10) -> DataFrame:
    return results.top_k(rounded(found), k)


# SQL that many of the oracles share

STOPS = "[" + ", ".join(f"'{w}'" for w in T.ENGLISH_STOP_WORDS) + "]"
WORDS = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+"


def tokens_sql(source: str = "documents", key: str = "doc_id", column: str = "text", prefix: str = "") -> str:
    """CTEs: words by document, positions, postings with counts and lengths, and the field's statistics."""
    p = prefix
    return f"""
{p}toks AS (SELECT {key} AS doc_id, list_filter(regexp_extract_all(lower({column}), '{WORDS}'), lambda t: NOT list_contains({STOPS}, t)) AS terms FROM {source}),
{p}pos AS (SELECT doc_id, len(terms) AS len, unnest(terms) AS term, unnest(range(0, len(terms))) AS pos FROM {p}toks),
{p}post AS (SELECT doc_id, term, len, count(*) AS tf FROM {p}pos GROUP BY ALL),
{p}df AS (SELECT term, count(*) AS df, sum(tf) AS ctf FROM {p}post GROUP BY term),
{p}st AS (SELECT count(*) AS n, avg(len(terms)) AS av FROM {p}toks)"""


def bm25_sql(tf="tf", length="len", av="av", n="n", df="df") -> str:
    return f"(greatest(ln(({n} - {df} + 0.5) / ({df} + 0.5)), 0.01) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * {length} / {av})))"


def term_sql(term: str, prefix: str = "") -> str:
    p = prefix
    return f"(SELECT doc_id, {bm25_sql()} AS score FROM {p}post JOIN {p}df USING (term), {p}st WHERE term = '{term}')"


def top_sql(body: str, k: int = 10, with_: str = "") -> str:
    return f"WITH {with_ or tokens_sql()} SELECT doc_id, round(score, 6) AS score FROM ({body}) ORDER BY round(score, 6) DESC, doc_id LIMIT {k}"


# Analysis


@query(f"WITH {tokens_sql()} SELECT doc_id, coalesce(len(terms), 0) AS n_tokens FROM toks")
def analyze_standard(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce(F.size(STANDARD(F.col("text"))), F.lit(0)).alias("n_tokens"))


@query("SELECT p_partkey, array_to_string(flatten([[substring(p_name, i, k) for k in [2, 3] if i + k - 1 <= length(p_name)] for i in range(1, length(p_name))]), '|') AS grams FROM part")
def analyze_ngram(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.ngram_tokenizer(2, 3)(F.col("p_name")), "|").alias("grams"))


@query(f"SELECT doc_id, len(w) AS n_all, len(list_filter(w, lambda t: NOT list_contains({STOPS}, t))) AS n_kept FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORDS}') AS w FROM documents)")
def analyze_stop(spark, sf):
    all_words = STANDARD_KEEPING_STOP_WORDS(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(all_words).alias("n_all"), F.size(T.stop()(all_words)).alias("n_kept"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda t: regexp_replace(lower(t), '^(.{3,}?)(?:" + "|".join(sorted(T.SIMPLE_SUFFIXES, key=len, reverse=True)) + ")$', '\\1')), ' ') AS stems FROM part")
def analyze_simple_stem(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.simple_stem(T.whitespace_tokenizer(F.col("p_name"))), " ").alias("stems"))


@query()
def analyze_porter(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.porter_stem(T.whitespace_tokenizer(F.col("p_name"))), " ").alias("stems"))


@query("SELECT p_partkey, replace(replace(replace(p_name, 'red', 'rouge'), 'blue', 'bleu'), ' ', '_') AS mapped, regexp_replace(p_name, '[aeiou]', '$0', 'g') AS replaced FROM part")
def analyze_char_filters(spark, sf):
    rules = T.mapping_filter({"red": "rouge", "blue": "bleu", " ": "_"})
    return table(spark, sf, "part").select("p_partkey", rules(F.col("p_name")).alias("mapped"), T.pattern_filter("[aeiou]", "$0")(F.col("p_name")).alias("replaced"))


@query(f"SELECT doc_id, array_to_string(list_slice(regexp_extract_all(lower(text), '{WORDS}'), 1, 5), ' ') AS head FROM documents WHERE text IS NOT NULL")
def analyze_limit(spark, sf):
    chain = Analyzer(T.regex_tokenizer(), (T.lowercase, T.strip, T.remove_empty, T.limit(5)))
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", F.array_join(chain(F.col("text")), " ").alias("head"))


# Index


@query(f"WITH {tokens_sql()} SELECT term, df, CAST(ctf AS BIGINT) AS ctf FROM df")
def index_term_stats(spark, sf):
    return build(table(spark, sf, "documents"), ["text"]).term_stats.select("term", "df", "ctf")


@query(f"WITH {tokens_sql()} SELECT count(*) AS n, count(terms) AS doc_count, round(avg(len(terms)), 6) AS avg_len, min(len(terms)) AS min_len, max(len(terms)) AS max_len FROM toks")
def index_field_stats(spark, sf):
    return rounded(doc_index(spark, sf).field_stats.select("n", "doc_count", "avg_len", "min_len", "max_len"), "avg_len")


# Terms and scoring functions


@query(top_sql(f"SELECT * FROM {term_sql('re')}"))
def term_bm25_topk(spark, sf):
    return best(hits(A.Term("text", "re"), doc_index(spark, sf)))


@query(top_sql("SELECT doc_id, (1 + ln(tf)) * ln(n / df) * sqrt(av / len) AS score FROM post JOIN df USING (term), st WHERE term = 're'"))
def tfidf_topk(spark, sf):
    return best(term_hits(doc_index(spark, sf), "text", [("re", 1.0)], "tf_idf").select("doc_id", "score"))


@query(top_sql("SELECT doc_id, sum(w) / (sqrt(sum(w * w)) * sqrt(3)) AS score FROM (SELECT doc_id, (1 + ln(tf)) * ln(n / df) * sqrt(av / len) AS w FROM post JOIN df USING (term), st WHERE term IN ('re', 'ha', 'th')) GROUP BY doc_id"))
def vector_space_topk(spark, sf):
    weights = term_hits(doc_index(spark, sf), "text", [("re", 1.0), ("ha", 1.0), ("th", 1.0)], "tf_idf")
    by_doc = weights.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("number", "score"))).alias("w"))
    full = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.coalesce(F.element_at("w", i), F.lit(0.0)))
    return best(by_doc.select("doc_id", scores.vector_space(full).alias("score")))


@query(top_sql(f"SELECT doc_id, sum({bm25_sql()}) * count(*) / 3.0 AS score FROM post JOIN df USING (term), st WHERE term IN ('re', 'ha', 'th') GROUP BY doc_id"))
def coord_boost(spark, sf):
    rows = term_hits(doc_index(spark, sf), "text", [("re", 1.0), ("ha", 1.0), ("th", 1.0)])
    total = F.sum("score") * scores.coordination(F.count("*"), 3)
    return best(rows.groupBy("doc_id").agg(total.alias("score")))


# Boolean queries


def t(word: str, boost: float = 1.0) -> A.Term:
    return A.Term("text", word, boost)


def sum_sql(*terms: str, where: str = "", having: str = "") -> str:
    listed = ", ".join(f"'{x}'" for x in terms)
    return f"SELECT doc_id, sum({bm25_sql()}) AS score FROM post JOIN df USING (term), st WHERE term IN ({listed}) {where} GROUP BY doc_id {having}"


@query(top_sql(sum_sql("re", "ha", having="HAVING count(*) = 2")))
def bool_must(spark, sf):
    return best(hits(A.Bool(must=(t("re"), t("ha"))), doc_index(spark, sf)))


@query(top_sql(sum_sql("re", "th", "tion")))
def bool_should(spark, sf):
    return best(hits(A.Bool(should=(t("re"), t("th"), t("tion"))), doc_index(spark, sf)))


@query(top_sql(sum_sql("re", where="AND doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'ha')")))
def bool_must_not(spark, sf):
    return best(hits(A.Bool(must=(t("re"),), must_not=(t("ha"),)), doc_index(spark, sf)))


@query(f"WITH {tokens_sql()} SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM post WHERE term = 're')")
def bool_only_not(spark, sf):
    return hits(A.Bool(must_not=(t("re"),)), doc_index(spark, sf))


@query(top_sql(sum_sql("re", "ha", "th", having="HAVING count(*) >= 2")))
def bool_msm2(spark, sf):
    return best(hits(A.Bool(should=(t("re"), t("ha"), t("th")), minimum_should_match=2), doc_index(spark, sf)))


@query("SELECT count(*) AS total_hits, max(score) AS max_score FROM (SELECT 1.0::DOUBLE AS score FROM documents)")
def match_all(spark, sf):
    return results.summary(hits(A.MatchAll(), doc_index(spark, sf)))


# Phrases and spans

PHRASE = "greatest(ln((n - m + 0.5) / (m + 0.5)) + 0.1, 0.1) * 1.2 * 1.2 * (1.5 * f) * 2.2 / (1.5 * f + 1.2)"


def phrase_sql(test: str, first: str, second: str) -> str:
    freq = f"SELECT x.doc_id, count(DISTINCT x.pos) AS f FROM pos x JOIN pos y ON x.doc_id = y.doc_id AND {test} WHERE x.term = '{first}' AND y.term = '{second}' GROUP BY x.doc_id"
    return top_sql(f"SELECT doc_id, {PHRASE} AS score FROM ({freq}), (SELECT count(*) AS m FROM ({freq})), st")


@query(phrase_sql("y.pos = x.pos + 1", "anea", "eriner"))
def phrase_exact(spark, sf):
    return best(hits(A.Phrase("text", ("anea", "eriner")), doc_index(spark, sf)))


@query(phrase_sql("y.pos BETWEEN x.pos + 1 AND x.pos + 4", "re", "ha"))
def phrase_slop(spark, sf):
    return best(hits(A.Phrase("text", ("re", "ha"), slop=3), doc_index(spark, sf)))


def span_sql(spans: str) -> str:
    """Score of documents by their number of spans, given rows (doc_id, s, e)."""
    return top_sql(f"SELECT doc_id, {bm25_sql('f', 'av', 'av', 'n', 'm')} AS score FROM (SELECT doc_id, count(*) AS f FROM ({spans}) GROUP BY doc_id), (SELECT count(DISTINCT doc_id) AS m FROM ({spans})), st")


NEAR = "SELECT DISTINCT x.doc_id, least(x.pos, y.pos) AS s, greatest(x.pos, y.pos) + 1 AS e FROM pos x JOIN pos y ON x.doc_id = y.doc_id AND {test} WHERE x.term = 're' AND y.term = 'ha'"


@query(span_sql(NEAR.format(test="abs(x.pos - y.pos) BETWEEN 1 AND 3")))
def span_near(spark, sf):
    return best(hits(A.span_proximity("text", ("re", "ha"), 2), doc_index(spark, sf)))


@query(span_sql(f"SELECT b.* FROM ({NEAR.format(test="y.pos - x.pos BETWEEN 1 AND 81")}) b WHERE EXISTS (SELECT 1 FROM pos z WHERE z.doc_id = b.doc_id AND z.term = 'th' AND z.pos >= b.s AND z.pos < b.e)"))
def span_containing(spark, sf):
    big = A.SpanNear((A.SpanTerm("text", "re"), A.SpanTerm("text", "ha")), 80, True)
    return best(hits(A.SpanContaining(big, A.SpanTerm("text", "th")), doc_index(spark, sf)))


@query(span_sql("SELECT x.doc_id, x.pos AS s, x.pos + 1 AS e FROM pos x WHERE x.term = 're' AND EXISTS (SELECT 1 FROM pos y WHERE y.doc_id = x.doc_id AND y.term = 'ha' AND abs(x.pos - y.pos) - 1 <= 3)"))
def span_within(spark, sf):
    return best(hits(A.SpanWithin(A.SpanTerm("text", "re"), A.SpanTerm("text", "ha"), 3), doc_index(spark, sf)))


# Expanding queries

ASCII_TERM = r"regexp_replace(term, '[^\x00-\x7F]', '?', 'g')"


@query(top_sql(f"SELECT doc_id, max((1 - 0.2 * edits) * {bm25_sql()}) AS score FROM post JOIN (SELECT term, df, levenshtein({ASCII_TERM}, 'tion') AS edits FROM df WHERE levenshtein({ASCII_TERM}, 'tion') <= 1 ORDER BY edits, df DESC, term LIMIT 50) USING (term), st GROUP BY doc_id"))
def fuzzy_lev1(spark, sf):
    return best(hits(A.Fuzzy("text", "tion", max_edits=1, transpositions=False), doc_index(spark, sf)))


# At one edit a swap of neighbours is all that optimal string alignment adds, as in the unrestricted distance.
@query(top_sql(f"SELECT doc_id, max((1 - 0.2 * edits) * {bm25_sql()}) AS score FROM post JOIN (SELECT term, df, damerau_levenshtein({ASCII_TERM}, 'tino') AS edits FROM df WHERE damerau_levenshtein({ASCII_TERM}, 'tino') <= 1 ORDER BY edits, df DESC, term LIMIT 50) USING (term), st GROUP BY doc_id"))
def fuzzy_osa(spark, sf):
    return best(hits(A.Fuzzy("text", "tino", max_edits=1), doc_index(spark, sf)))


def wildcard_sql(source: str, key: str, column: str, rx: str, pattern: str) -> str:
    c = scores.pattern_complexity(pattern)
    return f"""
WITH found AS (SELECT {key} AS doc_id, len(list_filter(regexp_split_to_array({column}, '\\s+'), lambda t: regexp_full_match(t, '{rx}'))) AS tf FROM {source}),
hit AS (SELECT * FROM found WHERE tf > 0), tot AS (SELECT count(*) AS df, sum(tf) AS ctf FROM hit), st AS (SELECT count(*) AS n FROM {source})
SELECT doc_id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 0.1) * greatest(ln(n / df), 0.1) * (tf * 2.2 / (tf + 1.2)) * {c!r} * (1 + 0.1 * ctf / df), 6) AS score FROM hit, tot, st ORDER BY 2 DESC, 1 LIMIT 10"""


@query(wildcard_sql("part", "p_partkey", "p_name", "wid.*", "wid*"))
def wildcard_prefix(spark, sf):
    return best(hits(A.Wildcard("p_name", "wid*"), part_index(spark, sf)))


@query(wildcard_sql("part", "p_partkey", "p_name", ".*i.g", "*i?g"))
def wildcard_inner(spark, sf):
    return best(hits(A.Wildcard("p_name", "*i?g"), part_index(spark, sf)))


@query(f"WITH {tokens_sql()} SELECT DISTINCT doc_id, 1.0::DOUBLE AS score FROM post WHERE starts_with(term, 'tion')")
def prefix_constant(spark, sf):
    return hits(A.Prefix("text", "tion"), doc_index(spark, sf))


@query(top_sql(f"SELECT doc_id, sum({bm25_sql(df='m')}) AS score FROM post JOIN (SELECT term, max(df) OVER () AS m FROM (SELECT term, df FROM df WHERE starts_with(term, 'tion') ORDER BY df DESC, term LIMIT 50)) USING (term), st GROUP BY doc_id"))
def prefix_blended(spark, sf):
    return best(hits(A.Prefix("text", "tion", rewrite="blended"), doc_index(spark, sf)))


# Ranges and places


def range_sql(source: str, key: str, column: str, test: str, near: str, factor: float) -> str:
    return f"""
WITH hit AS (SELECT {key} AS doc_id, {column} AS v FROM {source} WHERE {test}), m AS (SELECT count(*) AS m FROM hit), st AS (SELECT count(*) AS n FROM {source})
SELECT doc_id, round(greatest(0.5, (CASE WHEN ln((n - m + 0.5) / (m + 0.5)) < 0 THEN 0.5 ELSE ln((n - m + 0.5) / (m + 0.5)) END) * {factor!r}) * (CASE WHEN v = 0 THEN 1.5 ELSE {near} END), 6) AS score FROM hit, m, st"""


@query(range_sql("part", "p_partkey", "p_size", "p_size BETWEEN 10 AND 20", "1 + greatest(0, 1 - abs(v - 15) / 5.0)", 1 + 2))
def numeric_range_incl(spark, sf):
    return rounded(hits(A.NumericRange("p_size", 10.0, 20.0), part_index(spark, sf)))


@query(range_sql("part", "p_partkey", "p_retailprice", "p_retailprice > 905 AND p_retailprice < 965", "1 + greatest(0, 1 - abs(v - 935) / 30.0)", 1 + 100 / 61))
def numeric_range_excl(spark, sf):
    return rounded(hits(A.NumericRange("p_retailprice", 905.0, 965.0, False, False), part_index(spark, sf)))


@query(range_sql("part", "p_partkey", "p_size", "p_size >= 45", "1 + least(1 / (abs(v - 45) + 1), 1)", 1 + 100 / 1001) + " ORDER BY 2 DESC, 1 LIMIT 20")
def range_score(spark, sf):
    return best(hits(A.NumericRange("p_size", low=45.0), part_index(spark, sf)), 20)


@query("""
WITH hit AS (SELECT c_custkey AS doc_id FROM customer WHERE c_name BETWEEN 'Customer#000000010' AND 'Customer#000000099'), m AS (SELECT count(*) AS df FROM hit), st AS (SELECT count(*) AS n FROM customer)
SELECT doc_id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 0.01), 6) AS score FROM hit, m, st""")
def string_range(spark, sf):
    index = build(table(spark, sf, "customer"), {"c_name": Analyzer(T.whole_tokenizer)}, key="c_custkey")
    return rounded(hits(A.StringRange("c_name", "Customer#000000010", "Customer#000000099"), index))


@query("""
WITH hit AS (SELECT event_id AS doc_id FROM events WHERE date_trunc('second', ts) > TIMESTAMP '2024-01-03 00:00:00' AND date_trunc('second', ts) <= TIMESTAMP '2024-01-05 12:00:00'), m AS (SELECT count(*) AS df FROM hit), st AS (SELECT count(*) AS n FROM events)
SELECT doc_id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 0.01), 6) AS score FROM hit, m, st""")
def datetime_range(spark, sf):
    index = build(table(spark, sf, "events"), ["event_type"], key="event_id")
    return rounded(hits(A.DateTimeRange("ts", datetime(2024, 1, 3), datetime(2024, 1, 5, 12), include_low=False), index))


def places(spark, sf) -> DataFrame:
    lat, lon = (F.col("user_id") * 37) % 180 - 90, (F.col("user_id") * 91) % 360 - 180
    return table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), "event_type", F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon")).alias("place"))


PLACES = "p AS (SELECT event_id AS doc_id, CAST((user_id * 37) % 180 - 90 AS DOUBLE) AS lat, CAST((user_id * 91) % 360 - 180 AS DOUBLE) AS lon FROM events)"


def km_sql(lat: float, lon: float) -> str:
    return f"(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({lat} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * pow(sin(radians({lon} - lon) / 2), 2)))))"


@query(f"WITH {PLACES} SELECT doc_id, round(CASE WHEN km = 0 THEN 1 ELSE 1 - km / 3000 END, 6) AS score FROM (SELECT doc_id, {km_sql(10.0, 20.0)} AS km FROM p) WHERE km <= 3000")
def geo_distance(spark, sf):
    return rounded(hits(A.GeoDistance("place", 10.0, 20.0, 3000.0), build(places(spark, sf), ["event_type"])))


BOX = geo.Box(50.0, -60.0, 0.0, 40.0)


@query(f"WITH {PLACES} SELECT doc_id, round(({BOX.farthest_km!r} - {km_sql(*BOX.centre)}) / {BOX.farthest_km!r}, 6) AS score FROM p WHERE lat BETWEEN 0 AND 50 AND lon BETWEEN -60 AND 40")
def geo_bbox(spark, sf):
    return rounded(hits(A.GeoBox("place", 50.0, -60.0, 0.0, 40.0), build(places(spark, sf), ["event_type"])))


@query(f"WITH {PLACES} SELECT doc_id, round((degrees(atan2(sin(radians(20 - lon)) * cos(radians(10)), cos(radians(lat)) * sin(radians(10)) - sin(radians(lat)) * cos(radians(10)) * cos(radians(20 - lon)))) + 360) % 360, 4) AS bearing FROM p")
def geo_bearing(spark, sf):
    return places(spark, sf).select("doc_id", F.round(geo.bearing(F.col("place.lat"), F.col("place.lon"), 10.0, 20.0), 4).alias("bearing"))


# Composite queries

PART = tokens_sql("part", "p_partkey", "p_name", "a") + "," + tokens_sql("part", "p_partkey", "p_type", "b")
PART_ROWS = f"SELECT doc_id, 'a' AS name, term, {bm25_sql()} * 2 AS s FROM apost JOIN adf USING (term), ast WHERE term IN ('small', 'widget') UNION ALL SELECT doc_id, 'b', term, {bm25_sql()} FROM bpost JOIN bdf USING (term), bst WHERE term IN ('small', 'widget')"
PART_FIELDS = f"SELECT doc_id, name, sum(s) AS s FROM ({PART_ROWS}) GROUP BY doc_id, name"


@query(top_sql(f"SELECT doc_id, max(s) + 0.3 * (sum(s) - max(s)) AS score FROM ({PART_FIELDS}) GROUP BY doc_id", with_=PART))
def multi_field_best(spark, sf):
    return best(hits(A.MultiField("Small widget", {"p_name": 2.0, "p_type": 1.0}, "best", 0.3), part_index(spark, sf)))


@query(top_sql(f"SELECT doc_id, sum(s) AS score FROM ({PART_FIELDS}) GROUP BY doc_id HAVING count(*) = 2", with_=PART))
def multi_field_most(spark, sf):
    return best(hits(A.MultiField("Small widget", {"p_name": 2.0, "p_type": 1.0}, "most"), part_index(spark, sf)))


@query(top_sql(f"SELECT doc_id, sum(m) AS score FROM (SELECT doc_id, term, max(s) AS m FROM ({PART_ROWS}) GROUP BY doc_id, term) GROUP BY doc_id", with_=PART))
def multi_field_cross(spark, sf):
    return best(hits(A.MultiField("Small widget", {"p_name": 2.0, "p_type": 1.0}, "cross"), part_index(spark, sf)))


@query(top_sql(f"SELECT doc_id, 1.5 * score AS score FROM ({sum_sql('re', 'ha')}) WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'tion') AND doc_id IN (SELECT doc_id FROM documents WHERE n_chars <= 4000) AND 1.5 * score >= 0.2"))
def advanced_filters(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    core = A.Bool(should=(t("re"), t("ha")))
    full = A.Advanced(core, filters=(A.NumericRange("quality", 1.0, 1.0),), negative_filters=(t("tion"),), post_filters=(A.NumericRange("n_chars", high=4000.0),), min_score=0.2, boost=1.5)
    return best(hits(full, build(docs, ["text"])))


@query(top_sql(f"SELECT r.doc_id, r.score + coalesce(2 * h.score, 0) AS score FROM {term_sql('re')} r LEFT JOIN {term_sql('ha')} h USING (doc_id) WHERE r.doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'th')"))
def dsl_search(spark, sf):
    return best(Engine(index=doc_index(spark, sf), default_fields=("text",)).hits("+re ha^2 -th"))


@query("SELECT p_partkey AS doc_id, p_name FROM part WHERE p_size BETWEEN 10 AND 20 AND list_contains(string_split(lower(p_name), ' '), 'small') AND NOT list_contains(string_split(lower(p_name), ' '), 'ring')")
def dsl_range(spark, sf):
    engine = Engine(index=part_index(spark, sf))
    return engine.hits("p_name:small AND p_size:[10 TO 20] -p_name:ring").join(engine.index.docs, "doc_id").select("doc_id", "p_name")


SYNONYMS = [["small", "tiny piece"], ["widget", "gadget", "red ring"]]


@query("SELECT p_partkey AS doc_id FROM part WHERE list_has_any(string_split(lower(p_name), ' '), ['widget', 'gadget']) OR regexp_matches(lower(p_name), '(^| )red ring( |$)')")
def synonym_search(spark, sf):
    return hits(S.Synonyms(SYNONYMS).query("p_name", ["widget"]), part_index(spark, sf)).select("doc_id")


@query(top_sql(f"""
SELECT doc_id, sum({bm25_sql()}) AS score FROM post JOIN (SELECT term, df.df, sum(tf) * greatest(ln((max(n) - df.df + 0.5) / (df.df + 0.5)), 0.01) AS w FROM post JOIN df USING (term), st WHERE doc_id IN (3, 8) GROUP BY term, df.df ORDER BY w DESC, term LIMIT 10) USING (term), st
WHERE doc_id NOT IN (3, 8) GROUP BY doc_id"""))
def more_like_this(spark, sf):
    return best(hits(A.MoreLikeThis(("text",), (3, 8), max_terms=10), doc_index(spark, sf)))


# Sorting, counting, facets, groups, aggregations


@query("SELECT o_orderkey AS doc_id, o_totalprice AS sort_value FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_by_field(spark, sf):
    index = build(table(spark, sf, "orders"), ["o_orderpriority"], key="o_orderkey")
    return results.top_by_field(hits(A.NumericRange("o_totalprice", 1000.0, 200000.0), index), index.docs, "o_totalprice", 25, descending=True).select("doc_id", "sort_value")


@query("SELECT count(*) AS total_hits FROM orders WHERE o_totalprice > 100000 AND o_orderpriority LIKE '%URGENT'")
def count_query(spark, sf):
    index = build(table(spark, sf, "orders"), ["o_orderpriority"], key="o_orderkey")
    found = hits(A.Bool(must=(A.Term("o_orderpriority", "urgent"),), filter=(A.NumericRange("o_totalprice", 100000.0, include_low=False),)), index)
    return found.agg(F.count("*").alias("total_hits"))


@query("SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1")
def facet_terms(spark, sf):
    return results.facet(table(spark, sf, "orders"), "o_orderpriority")


def paths(spark, sf) -> DataFrame:
    nations = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows
    path = F.concat_ws("/", "r_name", "n_name", "c_mktsegment").alias("path")
    return table(spark, sf, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("doc_id"), path)


PATHS = "p AS (SELECT c_custkey AS doc_id, r_name, n_name, c_mktsegment, concat_ws('/', r_name, n_name, c_mktsegment) AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f"WITH {PATHS} SELECT value, count(*) AS count FROM (SELECT r_name AS value FROM p UNION ALL SELECT concat_ws('/', r_name, n_name) FROM p UNION ALL SELECT path FROM p) GROUP BY 1")
def facet_hier(spark, sf):
    return results.path_facet(paths(spark, sf), "path", size=100_000)


@query(f"WITH {PATHS} SELECT doc_id, path FROM p WHERE r_name = 'ASIA' AND NOT n_name = 'NATION_2' AND NOT starts_with(path, 'ASIA/NATION_7/')")
def facet_filter(spark, sf):
    return results.facet_filter(paths(spark, sf), "path", ["ASIA"], ["ASIA/NATION_2", "ASIA/NATION_7"])


@query("SELECT i AS bucket, '[' || lo || ' TO ' || coalesce(hi, '*') || ')' AS value, (SELECT count(*) FROM part WHERE p_size >= CAST(lo AS INT) AND (hi IS NULL OR p_size < CAST(hi AS INT))) AS count FROM (VALUES (0, '0', '15'), (1, '15', '30'), (2, '30', '45'), (3, '45', NULL)) AS b(i, lo, hi)")
def facet_range(spark, sf):
    return results.range_facet(table(spark, sf, "part"), "p_size", results.equal_buckets(0, 60, 4))


@query(f"WITH {tokens_sql()}, h AS (SELECT doc_id, round(score, 6) AS score, coalesce(lang, 'unknown') AS \"group\" FROM {term_sql('re')} JOIN documents USING (doc_id)) SELECT doc_id, score, \"group\", rank, group_count FROM (SELECT *, row_number() OVER (PARTITION BY \"group\" ORDER BY score DESC, doc_id) AS rank, count(*) OVER (PARTITION BY \"group\") AS group_count FROM h) WHERE rank <= 3")
def group_topn(spark, sf):
    index = doc_index(spark, sf)
    return results.grouped(rounded(hits(A.Term("text", "re"), index)), index.docs, "lang", 3).select("doc_id", "score", "group", "rank", "group_count")


@query(f"WITH {tokens_sql()} SELECT coalesce(lang, '[no value]') AS \"group\", count(*) AS total, round(max(score), 6) AS max_score FROM {term_sql('re')} JOIN documents USING (doc_id) GROUP BY 1")
def group_results(spark, sf):
    index = doc_index(spark, sf)
    return rounded(results.result_groups(hits(A.Term("text", "re"), index), index.docs, "lang"), "max_score")


@query("SELECT count(o_totalprice) AS count, round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 4) AS avg, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders")
def agg_stats(spark, sf):
    return results.statistics(table(spark, sf, "orders"), "o_totalprice").withColumns({"sum": F.round("sum", 2), "avg": F.round("avg", 4)})


@query("SELECT l_returnflag AS value, l_linestatus AS status, count(*) AS count, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1, 2")
def agg_terms(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("value"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("count"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS bucket, count(*) AS count FROM orders GROUP BY 1")
def agg_date_histogram(spark, sf):
    return results.date_histogram(table(spark, sf, "orders"), "o_orderdate")


@query("SELECT time_bucket(INTERVAL '6 hours', ts)::TIMESTAMP AS bucket, count(*) AS count FROM events GROUP BY 1")
def agg_time_windows(spark, sf):
    return results.date_histogram(table(spark, sf, "events"), "ts", "6 hours")


# Text of results


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN substring(text, 1, 40) || '...' ELSE text END AS snippet FROM documents")
def snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", results.snippet(F.col("text"), 40).alias("snippet"))


@query("SELECT p_partkey, regexp_replace(p_name, '(?i)\\b(widget|small)\\b', '<mark>\\1</mark>', 'g') AS marked FROM part")
def highlight_terms(spark, sf):
    return table(spark, sf, "part").select("p_partkey", highlight.highlight_terms(F.col("p_name"), ["small", "widget"]).alias("marked"))


@query()
def highlight_fragments(spark, sf):
    index = doc_index(spark, sf)
    wanted = A.Bool(should=(t("re"), t("ha")))
    top = results.fetch(best(hits(wanted, index)), index.docs, ["text"])
    found = highlight.highlight_fragments(F.col("text"), highlight.query_terms(wanted, "text"), most=2)
    return top.select("doc_id", "score", highlight.combined(found).alias("fragments"))


# More like this, by term vectors

SIM = """
q AS (SELECT term, tf AS q FROM post WHERE doc_id = 3), own AS (SELECT count(*) AS qn, sum(q) AS q1, sum(q * q) AS q2 FROM q),
sz AS (SELECT doc_id, count(*) AS n, sum(tf) AS s1, sum(tf * tf) AS s2 FROM post WHERE doc_id <> 3 GROUP BY doc_id),
j AS (SELECT doc_id, sum(tf * q) AS dot, count(*) AS common, sum(least(tf / sqrt(s2), q / sqrt(q2))) AS low, max(n) AS n, max(s1) AS s1, max(s2) AS s2, max(qn) AS qn, max(q1) AS q1, max(q2) AS q2 FROM post JOIN q USING (term) JOIN sz USING (doc_id), own GROUP BY doc_id)"""


def similar_sql(score: str) -> str:
    return f"WITH {tokens_sql()}, {SIM} SELECT doc_id, round({score}, 6) AS score FROM j WHERE {score} >= 0.01 ORDER BY 2 DESC, 1 LIMIT 20"


def similar_to_3(spark, sf, algorithm: str) -> DataFrame:
    return similar.similar(doc_index(spark, sf), [3], "text", algorithm, min_similarity=0.01, digits=6)


@query(similar_sql("dot / sqrt(s2 * q2)"))
def mlt_cosine(spark, sf):
    return similar_to_3(spark, sf, "cosine")


@query(similar_sql("common / (n + qn - common)"))
def mlt_jaccard(spark, sf):
    return similar_to_3(spark, sf, "jaccard")


@query(similar_sql("low / (s1 / sqrt(s2) + q1 / sqrt(q2) - low)"))
def mlt_tf(spark, sf):
    return similar_to_3(spark, sf, "term_frequency")


@query(similar_sql("1 / (1 + s1 / sqrt(s2) + q1 / sqrt(q2) - 2 * low)"))
def mlt_manhattan(spark, sf):
    return similar_to_3(spark, sf, "manhattan")


# Vectors


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")


def vector_of(spark, sf, vec_id: int) -> list[float]:
    return list(table(spark, sf, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"])


E = "embedding::DOUBLE[]"
Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {})"
COS = "list_cosine_similarity({a}, {b})"
GAPS = "list_transform(range(1, len({a}) + 1), lambda i: {a}[i] - {b}[i])"


def knn_sql(distance: str, score: str, where: str = "") -> str:
    return f"SELECT doc_id, round(d, 6) AS distance, round(greatest(0, least(1, {score})), 6) AS score FROM (SELECT vec_id AS doc_id, {distance} AS d FROM (SELECT *, {E} AS a, {Q.format(7)} AS b FROM embeddings) {where}) ORDER BY 3 DESC, 2, 1 LIMIT 10"


def knn_query(spark, sf, metric: str, rows: DataFrame | None = None) -> DataFrame:
    """Ordered by rounded values, as the SQL is."""
    found = V.distance(F.col("vec"), V.lit_vector(vector_of(spark, sf, 7)), metric)
    rows = (vectors(spark, sf) if rows is None else rows).select("doc_id", F.round(found, 6).alias("distance"), F.round(V.similarity_of(found, metric), 6).alias("score"))
    return rows.orderBy(F.desc("score"), "distance", "doc_id").limit(10)


@query(knn_sql("1 - list_cosine_similarity(a, b)", "1 - d"))
def knn_cosine(spark, sf):
    return knn_query(spark, sf, "cosine")


@query(knn_sql("list_distance(a, b)", "exp(-d)"))
def knn_l2(spark, sf):
    return knn_query(spark, sf, "l2")


@query(knn_sql("list_sum(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i])))", "exp(-d)"))
def knn_l1(spark, sf):
    return knn_query(spark, sf, "l1")


@query(knn_sql("-list_inner_product(a, b)", "-d"))
def knn_dot(spark, sf):
    return knn_query(spark, sf, "dot")


@query(knn_sql("acos(greatest(-1, least(1, list_cosine_similarity(a, b))))", "1 - d / pi()").replace("round(d, 6)", "round(d, 4)").replace("least(1, 1 - d / pi())), 6)", "least(1, 1 - d / pi())), 4)"))
def knn_angular(spark, sf):
    found = V.distance(F.col("vec"), V.lit_vector(vector_of(spark, sf, 7)), "angular")
    rows = vectors(spark, sf).select("doc_id", F.round(found, 4).alias("distance"), F.round(V.similarity_of(found, "angular"), 4).alias("score"))
    return rows.orderBy(F.desc("score"), "distance", "doc_id").limit(10)


@query(knn_sql("1 - list_cosine_similarity(a, b)", "1 - d", "WHERE label = 3"))
def knn_filtered(spark, sf):
    rows = vectors(spark, sf).withColumn("metadata", F.create_map(F.lit("label"), F.col("label").cast("string")))
    return knn_query(spark, sf, "cosine", rows.filter(knn.has_all("metadata", {"label": "3"})))


SIMS = "greatest(0, least(1, list_cosine_similarity({}, {})))"


@query(f"SELECT vec_id AS doc_id, round({SIMS.format(E, Q.format(7))} + {SIMS.format(E, Q.format(9))}, 6) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 10")
def knn_multi_query(spark, sf):
    """Two query vectors for one field: their similarities add."""
    return best(multi(spark, sf, ["f"], [("f", 7, 1.0), ("f", 9, 1.0)], "weighted_sum").select("doc_id", "score"))


def multi(spark, sf, fields: list[str], asked: list[tuple[str, int, float]], mode: str) -> DataFrame:
    """Field f holds the embedding, field g the embedding reversed, with weight 0.5."""
    base = vectors(spark, sf)
    rows = base.select("doc_id", F.lit("f").alias("field"), "vec", F.lit(1.0).alias("weight"))
    if "g" in fields:
        rows = rows.unionByName(base.select("doc_id", F.lit("g").alias("field"), F.reverse("vec").alias("vec"), F.lit(0.5).alias("weight")))
    known = {f: knn.FieldConfig(64) for f in fields}
    request = knn.Request(tuple(knn.QueryVector(tuple(vector_of(spark, sf, i)), (f,), w) for f, i, w in asked), k=1000, mode=mode)
    return knn.search(rows.withColumn("metadata", F.create_map().cast("map<string,string>")), None, known, request)


TWO_FIELDS = f"SELECT vec_id AS doc_id, {SIMS.format(E, Q.format(7))} * 2 AS f, {SIMS.format(f'list_reverse({E})', Q.format(9))} * 0.5 AS g FROM embeddings"


@query(f"SELECT doc_id, round(f + g, 6) AS score FROM ({TWO_FIELDS}) ORDER BY 2 DESC, 1 LIMIT 10")
def knn_multifield_sum(spark, sf):
    return best(multi(spark, sf, ["f", "g"], [("f", 7, 2.0), ("g", 9, 1.0)], "weighted_sum").select("doc_id", "score"))


@query(f"SELECT doc_id, round(greatest(f, g), 6) AS score FROM ({TWO_FIELDS}) ORDER BY 2 DESC, 1 LIMIT 10")
def knn_multifield_max(spark, sf):
    return best(multi(spark, sf, ["f", "g"], [("f", 7, 2.0), ("g", 9, 1.0)], "max_sim").select("doc_id", "score"))


@query(f"SELECT query, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS r FROM (SELECT q.i AS query, vec_id AS doc_id, round(greatest(0, least(1, list_cosine_similarity({E}, q.v))), 6) AS score FROM embeddings, (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INT) AS i, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (1, 7, 9)) q)) WHERE r <= 5")
def knn_batch(spark, sf):
    scored = vectors(spark, sf).withColumn("vec", V.double(F.col("vec")))
    found = knn.knn_many(scored, [vector_of(spark, sf, i) for i in (1, 7, 9)], 5)
    return rounded(found).select("query", "doc_id", "score")


@query(f"SELECT vec_id AS doc_id, round(greatest(0, least(1, ab / (aa + bb - ab))), 6) AS tanimoto FROM (SELECT vec_id, list_inner_product(a, b) AS ab, list_inner_product(a, a) AS aa, list_inner_product(b, b) AS bb FROM (SELECT vec_id, {E} AS a, {Q.format(7)} AS b FROM embeddings))")
def vec_tanimoto(spark, sf):
    return vectors(spark, sf).select("doc_id", F.round(V.tanimoto(F.col("vec"), V.lit_vector(vector_of(spark, sf, 7))), 6).alias("tanimoto"))


@query(f"SELECT vec_id AS doc_id, round((corr(x, y) + 1) / 2, 6) AS pearson FROM (SELECT vec_id, unnest({E}) AS x, unnest({Q.format(7)}) AS y FROM embeddings) GROUP BY vec_id")
def vec_pearson(spark, sf):
    return vectors(spark, sf).select("doc_id", F.round(V.pearson(F.col("vec"), V.lit_vector(vector_of(spark, sf, 7))), 6).alias("pearson"))


@query(f"SELECT vec_id AS doc_id, round(count(*) FILTER (x > 0 AND y > 0) / count(*) FILTER (x > 0 OR y > 0), 6) AS jaccard FROM (SELECT vec_id, unnest({E}) AS x, unnest({Q.format(7)}) AS y FROM embeddings) GROUP BY vec_id")
def vec_jaccard(spark, sf):
    return vectors(spark, sf).select("doc_id", F.round(V.jaccard(F.col("vec"), V.lit_vector(vector_of(spark, sf, 7))), 6).alias("jaccard"))


@query(f"SELECT vec_id AS doc_id, round(a[1] / sqrt(list_inner_product(a, a)), 6) AS l2_first, round((a[1] - list_min(a)) / (list_max(a) - list_min(a)), 6) AS minmax_first FROM (SELECT vec_id, {E} AS a FROM embeddings)")
def vec_normalize(spark, sf):
    first = lambda form: F.round(F.get(V.normalised(F.col("vec"), form), F.lit(0)), 6)
    return vectors(spark, sf).select("doc_id", first("l2").alias("l2_first"), first("minmax").alias("minmax_first"))


@query(f"WITH x AS (SELECT vec_id, unnest({E}) AS v, unnest(range(0, len(embedding))) AS dim FROM embeddings), r AS (SELECT dim, min(v) AS lo, max(v) AS hi FROM x GROUP BY dim) SELECT vec_id AS doc_id, CAST(sum(CASE WHEN hi > lo THEN round((v - lo) / (hi - lo) * 255) ELSE 0 END) AS BIGINT) AS code_sum FROM x JOIN r USING (dim) GROUP BY vec_id")
def vec_quantize8(spark, sf):
    return knn.quantised(vectors(spark, sf)).select("doc_id", F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a + c).alias("code_sum"))


PROBES = 12  # of 16 clusters


@query()
def ivf_probe(spark, sf):
    rows = vectors(spark, sf)
    index = knn.ivf(rows, rows.count(), clusters=16)
    return rounded(index.probe(vector_of(spark, sf, 7), 10, probes=PROBES), "distance", "score")


def recall_of_probes(spark, sf, probes: int) -> tuple[int, float]:
    """Queries (every vec_id divisible by 100) and their mean recall of 10 against all vectors."""
    rows = vectors(spark, sf).select("doc_id", "vec")
    index = knn.ivf(rows, rows.count(), clusters=16)
    return index.recall(rows.filter(F.col("doc_id") % 100 == 0), 10, probes)


@query("SELECT count(*) AS queries, TRUE AS recall_is_enough FROM embeddings WHERE vec_id % 100 = 0")
def ivf_recall(spark, sf):
    queries_, recall = recall_of_probes(spark, sf, PROBES)
    return spark.createDataFrame([(queries_, recall >= 0.9)], "queries long, recall_is_enough boolean")


# Hybrid

LEX = f"lex AS (SELECT doc_id, round(score, 6) AS s FROM {term_sql('re')} ORDER BY 2 DESC, 1 LIMIT 50)"
VEC = f"vec AS (SELECT vec_id AS doc_id, round({SIMS.format(E, Q.format(7))}, 6) AS s FROM embeddings ORDER BY 2 DESC, 1 LIMIT 50)"


def hybrid_sql(norm_k: str, norm_v: str, score: str, join: str = "FULL JOIN", extra: str = "") -> str:
    one = "SELECT *, (SELECT {f} FROM {t}) AS x FROM {t}"
    side = lambda name, norm: f"SELECT doc_id, s, {norm} AS v FROM (SELECT *, min(s) OVER () AS lo, max(s) OVER () AS hi, avg(s) OVER () AS mu, stddev_pop(s) OVER () AS sd, dense_rank() OVER (ORDER BY s DESC) - 1 AS place, (SELECT count(DISTINCT s) FROM {name}) AS of_ FROM {name})"
    del one
    return f"WITH {tokens_sql()}, {LEX}, {VEC}, k AS ({side('lex', norm_k)}), w AS ({side('vec', norm_v)}), c AS (SELECT (SELECT count(*) FROM lex) AS nk, (SELECT count(*) FROM vec) AS nv) SELECT doc_id, round({score}, 6) AS score FROM (SELECT doc_id, k.v AS kv, w.v AS wv, k.s AS ks, w.s AS ws FROM k {join} w USING (doc_id)), c {extra} ORDER BY 2 DESC, 1 LIMIT 20"


def hybrid_query(spark, sf, **how) -> DataFrame:
    keyword = results.top_k(rounded(hits(A.Term("text", "re"), doc_index(spark, sf))), 50)
    vector = vectors(spark, sf).select("doc_id", F.round(V.similarity(F.col("vec"), V.lit_vector(vector_of(spark, sf, 7))), 6).alias("score"))
    return best(hybrid.combine(keyword, results.top_k(vector, 50), k=1000, **how).select("doc_id", "score"), 20)


MINMAX = "CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE s END"
ZSCORE = "CASE WHEN sd > 0 THEN ((s - mu) / sd + 3) / 6 ELSE s END"
RANK = "1 - place / of_"
SUM = "0.5 * coalesce(kv, 0) + 0.5 * coalesce(wv, 0)"


@query(hybrid_sql(MINMAX, MINMAX, SUM))
def hybrid_minmax_sum(spark, sf):
    return hybrid_query(spark, sf)


@query(hybrid_sql(ZSCORE, ZSCORE, SUM))
def hybrid_z_sum(spark, sf):
    return hybrid_query(spark, sf, normalisation="zscore")


@query(hybrid_sql(RANK, RANK, "CASE WHEN kv IS NULL THEN 0 ELSE 0.5 / (60 + (1 - kv) * nk) END + CASE WHEN wv IS NULL THEN 0 ELSE 0.5 / (60 + (1 - wv) * nv) END"))
def hybrid_rank_rrf(spark, sf):
    return hybrid_query(spark, sf, normalisation="rank", method="rrf")


@query(hybrid_sql(MINMAX, MINMAX, "CASE WHEN kv > 0 AND wv > 0 THEN 2 * kv * wv / (kv + wv) ELSE 0 END"))
def hybrid_harmonic(spark, sf):
    return hybrid_query(spark, sf, method="harmonic_mean")


@query(hybrid_sql("s", "s", "0.3 * kv + 0.7 * wv", "JOIN"))
def hybrid_both(spark, sf):
    return hybrid_query(spark, sf, normalisation="none", require_both=True, weights=(0.3, 0.7))


# Spelling

DICTIONARY = r"dict AS (SELECT w AS word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{M}]+')) AS w FROM documents) WHERE length(w) > 1 AND regexp_matches(w, '^[a-z]+$') GROUP BY w)"


def ascii_dictionary(spark, sf) -> spelling.Dictionary:
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{Nl}\p{M}]+"), F.lit(0))).alias("word"))
    words = words.filter(F.col("word").rlike("^[a-z]+$") & (F.length("word") > 1))
    return spelling.Dictionary(words.groupBy("word").agg(F.count("*").alias("freq")))


ASKED = ["tionn", "thh", "enr", "zzzzzz"]


@query(f"WITH {DICTIONARY}, near AS (SELECT q AS query_word, word, levenshtein(q, word) AS edits, freq FROM dict, (SELECT unnest({ASKED!r}) AS q) WHERE levenshtein(q, word) <= 2) SELECT * FROM near n WHERE edits = 0 OR NOT EXISTS (SELECT 1 FROM near m WHERE m.query_word = n.query_word AND m.edits = 0)")
def spell_suggest(spark, sf):
    asked = spark.createDataFrame([(w,) for w in ASKED], "query_word string")
    return spelling.suggestions(ascii_dictionary(spark, sf), asked, keyboard=False).select("query_word", "word", "edits", "freq")


@query(f"""WITH {DICTIONARY}, tot AS (SELECT sum(freq) AS total FROM dict), near AS (SELECT word, levenshtein('tionn', word) AS d, freq FROM dict WHERE levenshtein('tionn', word) <= 2)
SELECT word, round(CASE WHEN d = 0 THEN 1 ELSE least(1, (0.6 / (1 + d) + 0.4 * ln(freq) / ln(total)) * (CASE WHEN length(word) = 5 THEN 1 ELSE 0.9 END) * (1 + 0.2 * len(list_filter(range(1, least(length(word), 5) + 1), lambda i: substring(word, 1, i) = substring('tionn', 1, i))) / greatest(length(word), 5))) END, 6) AS score FROM near, tot WHERE d = 0 OR NOT EXISTS (SELECT 1 FROM near WHERE d = 0)""")
def spell_score(spark, sf):
    asked = spark.createDataFrame([("tionn",)], "query_word string")
    return rounded(spelling.suggestions(ascii_dictionary(spark, sf), asked, keyboard=False).select("word", "score"))


@query()
def did_you_mean(spark, sf):
    fix = spelling.Corrector(spelling.Dictionary.from_corpus(table(spark, sf, "documents"), "text")).correct("tionn thh")
    return spark.createDataFrame([(fix.query, fix.corrected, fix.did_you_mean, float(fix.confidence))], "query string, corrected string, did_you_mean string, confidence double")


@query("SELECT p_partkey, levenshtein('STANDARD COPPER', p_type) AS distance, CASE WHEN levenshtein('STANDARD COPPER', p_type) <= 9 THEN levenshtein('STANDARD COPPER', p_type) END AS within, round(1 - levenshtein('STANDARD COPPER', p_type) / greatest(length(p_type), 15), 6) AS similarity, levenshtein('STANDARD COPPER', p_type) <= 12 AS matches FROM part")
def levenshtein_matcher(spark, sf):
    word = strings.Matcher("STANDARD COPPER")
    c = F.col("p_type")
    return table(spark, sf, "part").select("p_partkey", word.distance(c).alias("distance"), word.distance_within(c, 9).alias("within"), F.round(word.similarity(c), 6).alias("similarity"), word.matches(c, 12).alias("matches"))


# Changes and columns


@query("""WITH changed AS (SELECT doc_id, lang, source FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id, 'zz', source FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id + 1000000, 'new', source FROM documents WHERE doc_id % 50 = 0)
SELECT lang, count(*) AS count FROM changed WHERE doc_id % 7 <> 3 GROUP BY lang""")
def upsert_delete_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    tenth = docs.filter(F.col("doc_id") % 10 == 0).withColumn("lang", F.lit("zz"))
    new = docs.filter(F.col("doc_id") % 50 == 0).withColumns({"doc_id": F.col("doc_id") + 1000000, "lang": F.lit("new")})
    after = ingest.upserted(ingest.upserted(docs, tenth), new)
    gone = after.filter(F.col("doc_id") % 7 == 3).select("doc_id")
    return ingest.without(after, gone).groupBy("lang").agg(F.count("*").alias("count"))


@query("SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1")
def column_frequencies(spark, sf):
    return columns.frequencies(table(spark, sf, "part"), "p_brand")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9")
def column_range(spark, sf):
    return columns.in_range(table(spark, sf, "part"), "p_size", 5, 9, key="p_partkey")


@query("SELECT count(*) AS rows, count(p_brand) AS \"values\", count(DISTINCT p_brand) AS \"distinct\", min(p_brand) AS min, max(p_brand) AS max FROM part")
def column_statistics(spark, sf):
    return columns.statistics(table(spark, sf, "part"), "p_brand")


@query("SELECT p_partkey, levenshtein(p_name, 'small widget') AS d, round(1 - levenshtein(p_name, 'small widget') / greatest(length(p_name), 12), 6) AS ratio FROM part")
def edit_distance(spark, sf):
    a, b = F.col("p_name"), F.lit("small widget")
    return table(spark, sf, "part").select("p_partkey", strings.levenshtein(a, b).alias("d"), F.round(strings.levenshtein_ratio(a, b), 6).alias("ratio"))
