"""The pipeline's stages against brute force, each on its own input."""

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stage_names():
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "packing"]


def test_language(spark, docs):
    kept = P.language_stage(spark, docs, SF)
    assert kept.columns == docs.columns and 0.9 * docs.count() <= kept.count() <= docs.count()


def test_lines(spark, docs):
    gone, want = brute.removed_lines(texts(docs).items()), {}
    for d, t in texts(docs).items():
        if t is not None:
            left = "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)
            if left == t or brute.words(left):
                want[d] = left
    assert texts(P.line_stage(spark, docs, SF)) == want


def test_near(spark, docs):
    want = {d for d, (_, c) in brute.near(texts(docs).items(), 5, 80).items() if c == d}
    assert set(texts(P.near_stage(spark, docs, SF))) == want


def test_benchmark(spark, docs):
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = texts(P.benchmark_stage(spark, docs, SF))
    for d, t in texts(docs).items():
        if t and len(t) < 2000:
            w = set(brute.plain_words(t))
            assert d in kept or any(len(w & set(brute.plain_words(x))) >= 5 and brute.overlap(t, x) for x in items)


def test_packing(spark, docs):
    assert {r["doc_id"] for r in P.packing_stage(spark, docs, SF).collect()} == set(texts(docs))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and repeated rows, ties, and columns whose names the stages use themselves."""
    line = "alpha beta gamma delta epsilon zeta eta theta"
    texts = [None, "", "123", line, line, line + " iota", "\n".join([line, "own words of this text stay here"]), "the plain text of one more document\nwith two lines"]
    rows = [(i if i < 7 else None, t, "en", i) for i, t in enumerate(texts)] + [(3, line, "fr", 3), (None, line, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int")
    return df.withColumns({c: F.lit(1) for c in ("n_removed", "n_lines", "gone", "gone_id", "label", "keys", "text_2")})


def test_odd_rows(spark, odd):
    """Each stage keeps all columns and does with odd rows what its docstring says."""
    ids = lambda df: sorted(str(r["doc_id"]) for r in df.collect())
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, odd, SF)
        assert kept.columns == odd.columns and kept.dtypes == odd.dtypes, name
        assert stage(spark, odd.limit(0), SF).count() == 0
    language = P.language_stage(spark, odd, SF)
    assert language.filter("text is null or text in ('', '123')").count() == 0
    cut = {(r["doc_id"], r["text"]): r["n_chars"] for r in P.line_stage(spark, odd, SF).collect()}
    assert (None, None) not in cut and (0, None) in cut and (1, "") in cut and (4, "") not in cut
    assert cut[6, "own words of this text stay here"] == len("own words of this text stay here")
    near = P.near_stage(spark, odd, SF)
    assert ids(near) == ["0", "1", "2", "3", "3", "6", "None", "None"]
    assert ids(P.benchmark_stage(spark, odd, SF)) == ids(odd)
    pieces = P.packing_stage(spark, odd, SF).collect()
    assert sum(r["start"] == 0 for r in pieces) == odd.count() and P.packing_stage(spark, odd.limit(0), SF).count() == 0
