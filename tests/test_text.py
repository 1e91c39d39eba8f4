import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sablefin.functions import strings, synonyms
from sablefin.functions import text as T
from sablefin.functions.analyzers import KEYWORD, NOOP, SIMPLE, STANDARD, PerField, analyse, japanese
from sablefin.functions.stem import stem


def on(spark, column, text):
    return spark.range(1).select(column(F.lit(text)).alias("x")).first()["x"]


def test_analyzers(spark):
    assert STANDARD.terms(spark, "The State of the Art!") == ["state", "art"]
    assert SIMPLE.terms(spark, "The Été") == ["The", "Été"]
    assert KEYWORD.terms(spark, "a b") == ["a b"] and KEYWORD.terms(spark, "") == [] and NOOP.terms(spark, "a") == []
    assert PerField(by_field={"k": KEYWORD}).of("k") is KEYWORD and PerField().of("x") is STANDARD
    assert japanese().terms(spark, "東京タワー ABC") == ["東京", "京タ", "タワ", "ワー", "abc"]


def test_tokenizers(spark):
    assert on(spark, T.ngram_tokenizer(1, 2), "abc") == ["a", "ab", "b", "bc", "c"]
    assert on(spark, T.ngram_tokenizer(2, 3), "a") == []
    assert on(spark, T.whitespace_tokenizer, " a　b  c ") == ["a", "b", "c"]
    assert on(spark, T.word_tokenizer, "don't pay 3.14, ok?") == ["don't", "pay", "3.14", "ok"]
    assert on(spark, T.regex_tokenizer(",", gaps=True), "a,,b") == ["a", "b"]


@pytest.mark.parametrize(("token", "kind"), [("ひら", "hiragana"), ("カナー", "katakana"), ("漢字", "cjk"), ("한글", "hangul"), ("12", "num"), ("a1", "alphanum"), ("?!", "punctuation"), (" ", "other")])
def test_kinds(spark, token, kind):
    assert on(spark, T.token_kind, token) == kind


def test_filters(spark):
    words = lambda f: spark.range(1).select(f(F.array(F.lit(" a "), F.lit(""), F.lit("running"))).alias("x")).first()["x"]
    assert words(T.strip) == ["a", "running"] and words(T.remove_empty) == [" a ", "running"] and words(T.limit(1)) == [" a "]
    assert words(T.simple_stem)[2] == "runn" and words(T.porter_stem)[2] == "run"
    assert [tuple(x) for x in words(lambda t: T.boosted(t, 2.0))][2] == ("running", 2, 2.0)


def test_char_filters(spark):
    assert on(spark, T.mapping_filter({"ab": "x", "abc": "y"}), "abcab-") == "yx-"
    assert on(spark, T.mapping_filter({"a": "b", "c": ""}), "cab") == "bb"
    assert on(spark, T.pattern_filter("[0-9]+", "$1"), "a12b") == "a$1b"
    assert on(spark, T.normalise_filter("NFKC"), "ﬁｘ") == "fix"
    with pytest.raises(ValueError):
        T.normalise_filter("NFX")
    assert T.spelled_out("時々 馬鹿々々しい いすゞ バナヽ 々") == "時時 馬鹿馬鹿しい いすず バナナ  "


@pytest.mark.parametrize(("word", "out"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("hopping", "hop"), ("relational", "relat"), ("happiness", "happi"), ("adoption", "adopt"), ("controll", "control"), ("at", "at")])
def test_porter(word, out):
    assert stem(word) == stem(word.upper()) == out


def test_distances(spark):
    row = lambda f, a, b: spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b")).alias("d")).first()["d"]
    assert row(strings.levenshtein, "kitten", "sitting") == 3 and row(strings.osa, "ca", "abc") == 3 and row(strings.osa, "ab", "ba") == 1
    assert row(lambda a, b: strings.levenshtein(a, b, 1), "kitten", "sitting") is None
    assert row(strings.levenshtein_ratio, "", "") == 0.0 and row(strings.common_prefix, "search", "seabird") == 3
    assert row(strings.keyboard, "search", "searcg") == 0.5 and row(strings.keyboard, "search", "searcp") == 1.0


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=6), st.text("ab", max_size=6))
def test_osa_bounds(a, b):
    plain, swaps = strings.aligned(a, b), strings.aligned(a, b, swaps=True)
    assert swaps <= plain <= 2 * swaps and swaps == strings.aligned(b, a, swaps=True)


def test_synonyms(tmp_path, spark):
    s = synonyms.Synonyms([["ml", "machine learning"], ["big", "large", "huge"]])
    assert s.of("ML") == ["machine learning"] and sorted(s.of("big")) == ["huge", "large"]
    graph = s.graph(["machine", "learning", "rocks"])
    assert sorted(w for w, _ in synonyms.paths(graph, 3)) == [["machine", "learning", "rocks"], ["ml", "rocks"]]
    long = s.graph(["ml", "rocks"], boost=0.8)
    assert sorted(synonyms.paths(long, 2)) == [(["machine", "learning", "rocks"], 0.8), (["ml", "rocks"], 1.0)]
    flat = synonyms.flattened(long, 2)
    assert all(0 <= t.position < 2 for t in flat) and len(flat) == len(long)
    (tmp_path / "s.json").write_text('[["a", "b c"]]')
    assert synonyms.Synonyms.load(str(tmp_path / "s.json")).of("a") == ["b c"]
    pairs = synonyms.synonym_pairs(spark.createDataFrame([(["A", "b"],)], "phrases array<string>")).collect()
    assert sorted(map(tuple, pairs)) == [("a", "b"), ("b", "a")]


def test_analyse_without_index(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, analyse(df, "text", SIMPLE).collect())) == [(1, "a", 1, 1, 3), (1, "b", 0, 2, 3)]
