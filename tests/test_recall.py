"""The recall of an IVF index, in one pass, is what its own search finds of the exact neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sablefin import catalog
from sablefin.operators import knn


@pytest.mark.parametrize("probes", [2, 4])
def test_recall_is_of_the_search(spark, probes):
    rows = catalog.vectors(spark, "/root/testdata/sf0.001").select("doc_id", "vec")
    index = knn.ivf(rows, rows.count(), clusters=8)
    asked = rows.filter(F.col("doc_id") % 50 == 0)
    found = {(r["query"], r["doc_id"]) for r in index.probe_many(asked, 10, probes).collect()}
    queries = asked.orderBy("doc_id").collect()
    exact = {(q["doc_id"], r["doc_id"]) for q in queries for r in knn.knn(rows, list(q["vec"]), 10).collect()}
    assert index.recall(asked, 10, probes, block=4) == (len(queries), len(found & exact) / len(exact))


def test_ties_and_rows_kept(spark):
    """Of a thousand equal vectors those with the least ids are kept; a task sends on k rows a query and not its pairs."""
    points = [(i, [1.0, 0.0], 0) for i in range(1000, 0, -1)] + [(2000, [0.0, 1.0], 1), (2001, [0.0, 0.0], 1)]
    rows = spark.createDataFrame(points, "doc_id long, v array<double>, cluster int").coalesce(1)
    got = knn.nearest_of(rows, np.array([[1.0, 0.0], [0.0, 2.0]]), np.array([[1.0, 0.0], [0.0, 1.0]]), 3, 1, "cosine").collect()
    assert sorted((r["query"], r["doc_id"], r["score"], r["probed"]) for r in got) == [(0, 1, 1.0, True), (0, 2, 1.0, True), (0, 3, 1.0, True), (1, 1, 0.0, False), (1, 2, 0.0, False), (1, 2000, 1.0, True)]
