import math

import pytest
from pyspark.sql import functions as F

from sablefin.functions import embed
from sablefin.functions import vectors as V
from sablefin.operators import hybrid, knn

ROWS = [(1, "t", [0.9, 0.1, 0.0, 0.0], 1.0, {"lang": "en"}), (1, "b", [0.8, 0.2, 0.0, 0.0], 1.0, {}), (2, "t", [0.1, 0.9, 0.1, 0.0], 0.5, {"lang": "ja"}), (3, "t", [0.0, 0.0, 1.0, 0.0], 1.0, {"lang": "en"})]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "doc_id long, field string, vec array<float>, weight double, metadata map<string,string>").cache()


def test_metrics(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    a, b, z = V.lit_vector([3, 4]), V.lit_vector([4, 3]), V.lit_vector([0, 0])
    assert one(V.distance(a, b, "cosine")) == pytest.approx(1 - 24 / 25) and one(V.distance(a, z)) == 1.0 and one(V.distance(a, z, "angular")) == pytest.approx(math.pi)
    assert one(V.distance(a, b, "l2")) == pytest.approx(math.sqrt(2)) and one(V.distance(a, b, "l1")) == 2 and one(V.distance(a, b, "dot")) == -24
    assert one(V.similarity(a, b, "dot")) == 1.0 and one(V.similarity(a, b, "l1")) == pytest.approx(math.exp(-2))
    assert one(V.spearman(a, b)) == pytest.approx(0, abs=1e-12) and one(V.pearson(a, z)) == 0.0 and one(V.tanimoto(z, z)) == 1.0 and one(V.jaccard(z, z)) == 1.0
    assert one(V.normalised(a)) == pytest.approx([0.6, 0.8]) and one(V.normalised(a, "l1")) == pytest.approx([3 / 7, 4 / 7]) and one(V.normalised(z)) == [0, 0]
    assert one(V.valid(a, 2)) and not one(V.valid(a, 3)) and not one(V.valid(V.lit_vector([float("nan")])))
    with pytest.raises(ValueError):
        V.metric("hamming")


def test_search(rows):
    fields = {"t": knn.FieldConfig(4), "b": knn.FieldConfig(4, base_weight=2.0)}
    ask = lambda **k: [(r["doc_id"], r["score"]) for r in knn.search(rows, rows.filter("field = 't'").select("doc_id", "metadata"), fields, knn.Request((knn.QueryVector((0.9, 0.1, 0.0, 0.0)),), **k)).collect()]
    assert ask()[0][0] == 1 and ask()[0][1] == pytest.approx(1 + 2 * 0.990, abs=0.02)
    assert [d for d, _ in ask(doc_filter={"lang": "ja"})] == [2] and {d for d, _ in ask(field_filter={"lang": "en"})} == {1, 3}
    assert ask(mode="max_sim")[0][1] == pytest.approx(2 * 0.990, abs=0.02) and len(ask(min_score=0.5)) == 1 and ask(k=0) == []
    for bad in ({"mode": "late_interaction"}, {"overfetch": 0.5}):
        with pytest.raises(ValueError):
            ask(**bad)
    with pytest.raises(ValueError):
        knn.search(rows, None, fields, knn.Request((knn.QueryVector((1.0,), ("x",)),)))
    assert knn.selected(("t*",), fields, ()) == ["t"]


def test_knn_batch_agrees(spark):
    data = spark.createDataFrame([(i, [math.sin(i * 7.0 + j) for j in range(8)]) for i in range(60)], "doc_id long, vec array<double>")
    queries = [[math.cos(j) for j in range(8)], [1.0] * 8]
    for name in ("cosine", "l2", "l1", "dot", "angular"):
        many = {(r["query"], r["doc_id"]): r["score"] for r in knn.knn_many(data, queries, 5, name).collect()}
        for q, v in enumerate(queries):
            one = {(q, r["doc_id"]): r["score"] for r in knn.knn(data, v, 60, name).collect()}
            assert sum(k in one and many[k] == pytest.approx(one[k], abs=1e-9) for k in many if k[0] == q) == 5


def test_ivf_and_quantised(spark):
    data = spark.createDataFrame([(i, [math.sin(i * 7.0 + j) for j in range(8)]) for i in range(100)], "doc_id long, vec array<double>").cache()
    index = knn.ivf(data, 100, clusters=10)
    query = data.filter("doc_id = 5").first()["vec"]
    assert index.probe(query, 3, probes=10).first()["doc_id"] == 5 and index.probe(query, 3, probes=2).first()["doc_id"] == 5
    assert index.cluster_sizes().agg(F.sum("n")).first()[0] == 100 and index.plan_rebalance(2, 5).count() >= 0
    worst = knn.restored(knn.quantised(data)).select(F.array_max(F.zip_with("vec", "restored", lambda a, b: F.abs(a - b))).alias("d")).agg(F.max("d")).first()[0]
    assert worst <= 1 / 255 + 1e-9
    with pytest.raises(NotImplementedError):
        knn.compression_ratio(8, "product")


def test_reranking(spark):
    hits = spark.createDataFrame([(1, 0.9, 0.1, {"k": "a"}), (2, 0.8, 0.05, {"k": "b"})], "doc_id long, score double, distance double, metadata map<string,string>")
    assert [r["doc_id"] for r in knn.reranked(hits, "distance").collect()] == [2, 1]
    assert [r["doc_id"] for r in knn.reranked(hits, "weighted", {("k", "b"): 2.0}).collect()] == [2, 1]
    assert [r["score"] for r in knn.reranked(hits, normalise=True).collect()] == [1.0, 0.0]


def test_hybrid(spark):
    k = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 2.0)], "doc_id long, score double")
    v = spark.createDataFrame([(2, 0.9), (3, 0.5), (4, 0.7)], "doc_id long, score double")
    got = lambda **how: {r["doc_id"]: round(r["score"], 8) for r in hybrid.combine(k, v, **how).collect()}
    assert got() == {1: 0.5, 2: 0.5, 3: 0.25, 4: 0.25}
    assert got(method="rrf") == {1: 0.00833333, 2: 0.01626984, 3: 0.01606659, 4: 0.00813008}
    assert set(got(require_both=True)) == {2, 3} and set(got(min_keyword=2.5, min_vector=0.8)) == {1, 2}
    assert got(normalisation="rank")[1] == 0.5 and all(0 <= x <= 1 for x in got(normalisation="zscore").values())
    assert max(got(rescale=True).values()) == 1.0 and got(method="rrf_rank")[2] == round(0.5 / 63 + 0.5 / 61, 8)
    assert tuple(hybrid.coverage(k, v).first()) == (3, 3, 2)


def test_embedders(spark):
    df = spark.createDataFrame([("a b",), ("b a",), (None,)], "t string")
    out = [r["v"] for r in df.select(embed.HashingEmbedder(16)(F.col("t")).alias("v")).collect()]
    assert out[0] == out[1] and out[2] is None and sum(x * x for x in out[0]) == pytest.approx(1, abs=1e-5)
    with pytest.raises(ValueError):
        embed.PrecomputedEmbedder().vectors(["a"])
    assert embed.CallableEmbedder(lambda xs: [[len(x)] for x in xs], 1).vectors(["ab"]).tolist() == [[2.0]]
