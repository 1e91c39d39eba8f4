import pytest

from sablefin.operators import knn
from sablefin.streaming.collection import HybridCollection, VectorCollection
from sablefin.streaming.ingest import DocumentLog, Transaction


def rows(spark, *of):
    return spark.createDataFrame(list(of), "doc_id long, field string, vec array<float>")


def test_vector_collection(spark, tmp_path):
    c = VectorCollection(spark, f"{tmp_path}/c", implicit_schema=True)
    assert c.count() == 0 and c.add(rows(spark, (0, "title", [1.0, 0.0]), (0, "body", [1.0, 0.0, 0.0]), (1, "title", [0.0, 1.0]))) == 0
    assert c.add(rows(spark, (0, "title", [0.6, 0.8]))) == 2 and c.count() == 3
    assert {n: f.dimension for n, f in c.fields.items()} == {"title": 2, "body": 3}
    request = knn.Request((knn.QueryVector((1.0, 0.0), ("title",)),), k=2)
    assert [r["doc_id"] for r in c.search(request).collect()] == [0, 2]
    c.upsert(rows(spark, (0, "title", [0.0, 1.0])), spark.createDataFrame([(0, {"lang": "en"})], "doc_id long, metadata map<string,string>"))
    c.delete(spark.createDataFrame([(2,)], "doc_id long"))
    assert c.count() == 2 and {r["field"]: r["vectors"] for r in c.stats().collect()} == {"title": 2}  # the upsert replaced the whole document
    c.optimise()
    again = VectorCollection(spark, f"{tmp_path}/c")
    assert again.count() == 2 and set(again.fields) == {"title", "body"} and len(again.log.segments()) == 1
    assert [r["doc_id"] for r in again.search(knn.Request((knn.QueryVector((0.0, 1.0), ("title",)),), doc_filter={"lang": "en"})).collect()] == [0]
    for bad in ([(5, "title", [1.0])], [(5, "other", [1.0])], [(5, "title", [1.0, float("nan")])], [(5, "title", None)]):
        with pytest.raises(ValueError):
            again.upsert(rows(spark, *bad))
    assert again.count() == 2


def test_hybrid_upsert(spark, tmp_path):
    docs = lambda *of: spark.createDataFrame(list(of), "doc_id long, text string")
    c = HybridCollection(spark, f"{tmp_path}/h", {"v": knn.FieldConfig(dimension=2)})
    c.upsert(docs((1, "a"), (2, "b")), rows(spark, (1, "v", [1.0, 0.0])))
    with pytest.raises(ValueError):
        c.upsert(docs((1, "lost"), (3, "lost")), rows(spark, (3, "v", [1.0])))
    assert {r["doc_id"]: r["text"] for r in c.documents.documents().collect()} == {1: "a", 2: "b"} and c.vectors.count() == 1
    c.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert [r["doc_id"] for r in c.documents.documents().collect()] == [2] and c.vectors.count() == 0


def test_transactions(spark, tmp_path):
    docs = lambda *of: spark.createDataFrame(list(of), "doc_id long, text string")
    log = DocumentLog(spark, f"{tmp_path}/log")
    log.upsert(docs((1, "a")))
    now = lambda source: {r["doc_id"]: r["text"] for r in source.collect()}
    one, two = Transaction({"d": log}, "repeatable_read"), Transaction({"d": log}, "serializable")
    one.upsert("d", docs((1, "b"), (2, "c")))
    assert now(log.documents()) == {1: "a"}
    one.prepare()
    one.commit()
    assert now(log.documents()) == {1: "b", 2: "c"} and now(one.documents("d")) == {1: "a"}
    two.delete("d", docs((1, None)))
    with pytest.raises(RuntimeError):
        two.commit()
    assert two.state == "aborted" and now(log.documents()) == {1: "b", 2: "c"}
    with pytest.raises(ValueError):
        one.upsert("d", docs((9, "z")))
