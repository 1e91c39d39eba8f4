"""A saved index has the tables of the lazy one, on odd rows too, and takes one shuffle for its postings."""

import pytest
from pyspark.sql import functions as F

from sablefin.functions.analyzers import SIMPLE
from sablefin.operators import index as I
from sablefin.plans import ast as A
from sablefin.plans.compile import hits
from sablefin.sources.store import Store

ODD = {
    "plain": [(5, "red red blue", 1), (2, "Blue \u00e9t\u00e9 red", 2), (9, "the of", None), (7, "", 3), (8, None, 4), (1, "x " * 3000 + "red", 5)],
    "repeated": [(1, "red blue", 1), (1, "blue red", 2), (2, "red", 3), (1, "red red blue", 4)],
    "null ids": [(None, "red", 1), (None, "red", 2), (3, "blue", 3)],
    "one null id": [(None, "red", 1), (3, "red blue", 3)],
    "empty": [],
}


def same(a, b):
    names = sorted(a.columns)
    rows = lambda df: sorted(str(tuple(r)) for r in df.select(names).collect())
    assert names == sorted(b.columns) and rows(a) == rows(b)


@pytest.mark.parametrize(("kind", "key"), [*((k, "long") for k in ODD), ("plain", "string")])
def test_tables(spark, tmp_path, kind, key, monkeypatch):
    monkeypatch.setattr(I, "PAIRS_A_FILE", 3)
    rows = spark.createDataFrame(ODD[kind], "doc_id long, text string, price int").withColumn("doc_id", F.col("doc_id").cast(key))
    lazy = I.build(rows, {"text": SIMPLE, "price": None})
    store = Store(spark, str(tmp_path / "s"))
    store.save(lazy)
    kept = store.open()
    for t in I.TABLES:
        if t == "term_stats" and kind == "repeated":
            continue  # a saved index counts (doc_id, len), as the SQL does, a lazy one doc_id
        same(getattr(lazy, t), getattr(kept, t))
    assert [f.dataType.simpleString() for f in kept.postings.schema] == [f.dataType.simpleString() for f in lazy.postings.schema]


def test_one_shuffle(spark, tmp_path):
    """Of the terms' postings in a batch of documents; neither tokens nor positions are grouped by a shuffle of their own."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    index = I.build(docs, ["text"])
    sizes = I.sizes_of(index.terms)
    plan = I.laid_out(index, sizes, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "Aggregate" not in plan and "Join" not in plan


def test_fuzzy_terms_reach_the_scan(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.save(I.build(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), ["text"]))
    plan = hits(A.Fuzzy("text", "tion", max_edits=1), store.open())._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan or "EqualTo(term" in plan
    assert hits(A.Fuzzy("text", "qqqqqqqqqq", max_edits=1), store.open()).count() == 0
