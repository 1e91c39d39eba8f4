"""Scores that tie once rounded go by id, as in SQL, where a limit cuts among them."""

import duckdb
import pytest

from sablefin import catalog


@pytest.fixture(scope="module")
def near_ties(spark, tmp_path_factory):
    """Document 1 scores less than 10 to 29 by about 2e-7: the same to six digits."""
    sf = str(tmp_path_factory.mktemp("ties"))
    texts = {3: "xx yy", 1: "xx " * 2000 + "yy " * 2001} | {i: "xx " * 2001 + "yy " * 2002 for i in range(10, 30)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{sf}/documents.parquet")
    return sf


@pytest.mark.parametrize("name", ["mlt_manhattan", "mlt_tf", "mlt_cosine"])
def test_similar(spark, near_ties, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{near_ties}/documents.parquet/*.parquet')")
    want = con.execute(catalog.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in catalog.queries()[name](spark, near_ties).select("doc_id", "score").collect()]
    assert [i for i, _ in got] == [i for i, _ in want] and 1 in dict(got)
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-6)
