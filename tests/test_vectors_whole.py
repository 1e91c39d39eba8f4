"""Recall of the index query, and sums over fields that no limit cuts."""

import pytest
from pyspark.sql import functions as F

from sablefin import catalog
from sablefin.operators import knn


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_ivf_recall(spark, sf):
    """Mean recall of 10 against brute force over all vec_id divisible by 100, with the probes of ivf_probe."""
    queries, recall = catalog.recall_of_probes(spark, f"/root/testdata/{sf}", catalog.PROBES)
    print(sf, catalog.PROBES, queries, recall)
    assert queries > 4 and 0.9 <= recall <= 1


def test_many_probes(spark):
    """A table of queries gets what each gets alone, and everything with all clusters probed."""
    rows = catalog.vectors(spark, "/root/testdata/sf0.001").select("doc_id", "vec")
    index = knn.ivf(rows, rows.count(), clusters=4)
    asked = rows.filter("doc_id in (3, 5)")
    for probes in (2, 9):
        many = {(r["query"], r["doc_id"]) for r in index.probe_many(asked, 5, probes).collect()}
        assert many == {(q["doc_id"], r["doc_id"]) for q in asked.collect() for r in index.probe(q["vec"], 5, probes).collect()}


def test_ivf_rebalance(spark):
    """Sparse clusters go, dense ones are split, and every vector is with the nearest of the changed centroids or where it was."""
    points = [[float(i % 5) * 0.01, 0.0] for i in range(30)] + [[5.0 + (i % 3) * 0.01, 5.0] for i in range(30)] + [[-9.0, 9.0]] * 2 + [[9.0, -9.0]] * 12
    rows = spark.createDataFrame([(i, p, 0 if p[1] in (0.0, 5.0) else 1 if p[0] < 0 else 2) for i, p in enumerate(points)], "doc_id long, vec array<double>, cluster int")
    index = knn.Ivf(rows, [[2.5, 2.5], [-9.0, 9.0], [9.0, -9.0]])
    new = index.rebalanced(sparse=5, dense=40)
    sizes = {r["cluster"]: r["n"] for r in new.cluster_sizes().collect()}
    assert len(new.centroids) == 3 and sum(sizes.values()) == len(points) and sorted(sizes.values())[0] == 12 and max(sizes) < 3
    for r in new.vectors.collect():
        gaps = [sum((a - b) ** 2 for a, b in zip(c, r["vec"], strict=True)) for c in new.centroids]
        assert gaps[r["cluster"]] == min(gaps)


def test_sum_is_whole(spark):
    """A document outside one field's best k keeps that field's share."""
    data = [(1, "f", [1.0, 0.0]), (1, "g", [0.0, 1.0]), (2, "f", [0.8, 0.6]), (2, "g", [0.8, 0.6]), (3, "f", [0.0, 1.0]), (3, "g", [1.0, 0.0])]
    rows = spark.createDataFrame(data, "doc_id long, field string, vec array<double>").withColumns({"weight": F.lit(1.0), "metadata": F.create_map().cast("map<string,string>")})
    fields = {f: knn.FieldConfig(2) for f in "fg"}
    got = knn.search(rows, None, fields, knn.Request((knn.QueryVector((1.0, 0.0)),), k=1)).collect()
    assert [(r["doc_id"], round(r["score"], 6)) for r in got] == [(2, 1.6)]
