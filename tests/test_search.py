import pytest
from pyspark.sql import functions as F

from sablefin.engine import Engine
from sablefin.operators import highlight, results
from sablefin.operators.index import build
from sablefin.plans import ast as A
from sablefin.plans.compile import hits, spans
from sablefin.plans.parser import ParseError, Parser

DOCS = ["the quick brown fox", "quick quick fox", "lazy dog sleeps", "brown dog", "cat"]
PLACES = [("Central Park", 40.7829, -73.9654), ("Golden Gate", 37.8199, -122.4783), ("Alcatraz", 37.8267, -122.4233), ("Far", -33.0, 151.0)]


@pytest.fixture(scope="module")
def index(spark):
    return build(spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string"), ["text"]).cached()


def scored(index, q):
    return {r["doc_id"]: r["score"] for r in hits(q, index).collect()}


def term(w):
    return A.Term("text", w)


@pytest.mark.parametrize(("word", "want"), [("quick", {0: 0.305253, 1: 0.432256}), ("fox", {0: 0.305253, 1: 0.305253}), ("dog", {2: 0.305253, 3: 0.361092}), ("cat", {4: 1.442953}), ("the", {})])
def test_bm25(index, word, want):
    assert scored(index, term(word)) == pytest.approx(want, abs=1e-6)


def test_boolean_algebra(index):
    a, b = term("quick"), term("brown")
    assert scored(index, A.Bool(must=(a,), must_not=(a,))) == {}
    assert set(scored(index, A.Bool(should=(a, b)))) == {0, 1, 3}
    assert scored(index, A.Bool(should=(a, b)))[0] == pytest.approx(2 * 0.305253, abs=1e-5)
    assert set(scored(index, A.Bool(must=(a,), should=(b,)))) == {0, 1}
    assert set(scored(index, A.Bool(must=(a,), should=(b,), minimum_should_match=1))) == {0}
    assert set(scored(index, A.Bool(must_not=(a,)))) == {2, 3, 4} and set(scored(index, A.Bool(filter=(a,)))) == {0, 1}
    assert scored(index, A.Bool()) == {} and scored(index, A.MatchNone()) == {} and len(scored(index, A.MatchAll())) == 5
    same = A.Bool(must=(a, a))
    assert scored(index, same)[1] == pytest.approx(2 * 0.432256, abs=1e-5)


def test_phrases_and_spans(index, spark):
    assert set(scored(index, A.Phrase("text", ("quick", "brown")))) == {0}
    assert set(scored(index, A.Phrase("text", ("quick", "fox")))) == {1}
    assert set(scored(index, A.Phrase("text", ("quick", "fox"), slop=1))) == {0, 1}
    assert set(scored(index, A.Phrase("text", ("quick", "quick")))) == {1}
    stop = build(spark.createDataFrame([(7, "state of the art")], "doc_id long, text string"), ["text"])
    assert set(scored(stop, A.Phrase("text", ("state", "art")))) == {7}
    near = A.SpanNear((A.SpanTerm("text", "fox"), A.SpanTerm("text", "quick")), 1, False)
    assert {r["doc_id"]: len(r["spans"]) for r in spans(near, index).collect()} == {0: 1, 1: 2}
    assert scored(index, A.SpanNear((A.SpanTerm("text", "fox"), A.SpanTerm("text", "quick")), 1, True)) == {}
    assert set(scored(index, A.SpanContaining(near, A.SpanTerm("text", "brown")))) == {0}
    assert set(scored(index, A.SpanWithin(A.SpanTerm("text", "brown"), A.SpanTerm("text", "fox"), 0))) == {0}


def test_expansions(index):
    assert set(scored(index, A.Fuzzy("text", "quikc", 1))) == {0, 1} and scored(index, A.Fuzzy("text", "quikc", 1, transpositions=False)) == {}
    assert set(scored(index, A.Fuzzy("text", "dag", 1, prefix_length=1))) == {2, 3}
    assert set(scored(index, A.Wildcard("text", "qu?ck"))) == {0, 1} and set(scored(index, A.Wildcard("text", "*o*"))) == {0, 1, 2, 3}
    for rewrite in ("constant", "top_terms", "blended", "boolean"):
        assert set(scored(index, A.Prefix("text", "do", rewrite=rewrite))) == {2, 3}


def test_ranges_and_places(spark):
    rows = [(i, n, float(i), f"{i}.5", (la, lo)) for i, (n, la, lo) in enumerate(PLACES)]
    index = build(spark.createDataFrame(rows, "doc_id long, name string, price double, text_price string, at struct<lat:double,lon:double>"), ["name"])
    assert set(scored(index, A.NumericRange("price", 1.0, 3.0, include_high=False))) == {1, 2} and set(scored(index, A.NumericRange("text_price", low=2.0))) == {2, 3}
    assert set(scored(index, A.StringRange("name", "c", "g"))) == {0, 3}
    assert scored(index, A.GeoDistance("at", 40.7580, -73.9855, 5.0)) == pytest.approx({0: 0.350968}, abs=1e-3)
    assert set(scored(index, A.GeoDistance("at", 37.7749, -122.4194, 10.0))) == {1, 2}
    assert set(scored(index, A.GeoBox("at", 41.0, -123.0, 37.0, -73.0))) == {0, 1, 2}
    with pytest.raises(ValueError):
        hits(A.GeoBox("at", 0.0, 170.0, -10.0, -170.0), index)


def plain(field, text):
    return [w for w in text.lower().split() if w != "the"]


def test_parser():
    parse = Parser(plain, ("t",)).parse
    assert parse("a AND b") == A.Bool(must=(A.Term("t", "a"), A.Term("t", "b"))) and parse("a") == A.Term("t", "a")
    assert parse("a b") == parse("a OR b") == A.Bool(should=(A.Term("t", "a"), A.Term("t", "b")))
    assert Parser(plain, ("t",), compat=True).parse("a AND b c") == A.Bool(must=(A.Term("t", "b"), A.Term("t", "c")), should=(A.Term("t", "a"),))
    assert parse("+a -b^2") == A.Bool(must=(A.Term("t", "a"),), must_not=(A.Term("t", "b", 2.0),))
    assert parse('f:"a b"~2^1.5') == A.Phrase("f", ("a", "b"), 2, 1.5) and parse("f.g:a~1^2") == A.Fuzzy("f.g", "a", 1, boost=2.0) and parse("a~") == A.Fuzzy("t", "a", 2)
    assert parse("f:[1 TO 5]") == A.NumericRange("f", 1.0, 5.0) and parse("f:{* TO 5.5}") == A.NumericRange("f", None, 5.5, False, False) and parse("f:[aa TO bb]") == A.StringRange("f", "aa", "bb")
    assert parse("te?t*^2") == A.Wildcard("t", "te?t*", 2.0) and parse("(a b)^3") == A.Boosted(A.Bool(should=(A.Term("t", "a"), A.Term("t", "b"))), 3.0)
    assert parse("the") == A.MatchNone() and parse("oreo android") == A.Bool(should=(A.Term("t", "oreo"), A.Term("t", "android"))) and parse(r"a\-b") == A.Term("t", "a-b")
    assert Parser(plain, ("t", "u")).parse("a") == A.Bool(should=(A.Term("t", "a"), A.Term("u", "a"))) and Parser(plain).parse_field("f", "a b") == A.Phrase("f", ("a", "b"))
    for bad in ("", "(a", "f:[1 TO 5}", "a )"):
        with pytest.raises(ParseError):
            parse(bad)
    with pytest.raises(ParseError):
        Parser(plain).parse("a")


def test_engine(index, tmp_path, spark):
    engine = Engine(index=index)
    top = engine.search("quick OR dog", k=2).orderBy(F.desc("score")).collect()
    assert [r["doc_id"] for r in top] == [1, 3] and top[0]["text"] == DOCS[1]
    assert engine.count("text:quick") == 2 and engine.search("quick dog", k=1, sort_by="text").first()["doc_id"] == 3
    engine.save(f"{tmp_path}/i")
    again = Engine.open(spark, f"{tmp_path}/i")
    assert scored(again.index, term("quick")) == scored(index, term("quick"))
    plan = again.index.of_term("text", "quick")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,quick)" in plan and "positions" in plan


def test_results(spark):
    rows = spark.createDataFrame([(1, 0.5, "a/b", 3.0), (2, 0.9, "a/c", None), (3, 0.9, None, 7.0)], "doc_id long, score double, path string, v double")
    h = rows.select("doc_id", "score")
    assert [r["doc_id"] for r in results.top_k(h, 2).collect()] == [2, 3]
    assert [r["doc_id"] for r in results.top_by_field(h, rows, "v", 3, True).collect()] == [2, 3, 1]
    assert [tuple(r) for r in results.path_facet(rows, "path").collect()] == [("a", 2), ("a/b", 1), ("a/c", 1)]
    assert [tuple(r) for r in results.range_facet(rows, "v", results.equal_buckets(0, 8, 2)).collect()] == [(0, "[0 TO 4)", 1), (1, "[4 TO *)", 1)]
    assert {r["group"]: r["group_count"] for r in results.grouped(h, rows, "path", 1).collect()} == {"a/b": 1, "a/c": 1, "unknown": 1}
    assert results.facet_filter(rows, "path", ["a"], ["a/c"]).count() == 1
    depth = rows.select(results.path_depth(F.col("path")).alias("d"), results.path_parent(F.col("path")).alias("p")).first()
    assert (depth["d"], depth["p"]) == (2, "a")


def test_highlight(spark):
    df = spark.createDataFrame([("A fox and a foxhound; Fox!",)], "t string")
    assert df.select(highlight.highlight_terms(F.col("t"), ["fox"]).alias("x")).first()["x"] == "A <mark>fox</mark> and a foxhound; <mark>Fox</mark>!"
    assert highlight.fragments_of("x " * 200 + "fox" + " y" * 200, {"fox"}, 20)[0][0].count("<mark>fox</mark>") == 1
    assert highlight.query_terms(A.Bool(must=(A.Phrase("t", ("b", "a")),), must_not=(A.Term("t", "c"),)), "t") == ["a", "b"]
    cut = df.select(highlight.marked_snippet(F.col("t"), ["foxhound"], 12).alias("x")).first()["x"]
    assert "foxhound" in cut and cut.startswith("...") and cut.endswith("...")
