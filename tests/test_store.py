import json

import pytest
from pyspark.sql import functions as F

from sablefin.functions import text as T
from sablefin.functions.analyzers import SIMPLE, Analyzer, PerField
from sablefin.operators import spelling
from sablefin.operators.index import build
from sablefin.sources import readers
from sablefin.sources.store import Store
from sablefin.streaming import segments
from sablefin.streaming.ingest import DocumentLog, live, stream_into, windowed_counts


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string")


def test_store(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    assert not store.exists()
    first = store.save(build(docs(spark, (1, "a cat")), ["text"]))
    staged = store.stage(build(docs(spark, (1, "a cat"), (2, "cats")), ["text"]))
    assert store.open().docs.count() == 1
    store.rollback(staged)
    second = store.save(build(docs(spark, (2, "dog dog")), ["text"]))
    assert store.vacuum() == [first] and store.versions() == [second]
    assert [tuple(r) for r in store.open().term_stats.collect()] == [("text", "dog", 1, 2)]
    with pytest.raises(ValueError):
        store.rollback(second)
    assert store.prefixed("x").root.endswith("/s/x") and store.delete() and not store.exists()


def test_log(spark, tmp_path):
    log = DocumentLog(spark, f"{tmp_path}/log")
    log.add(docs(spark, (1, "a"), (2, "b"), (3, "c")))
    log.upsert(docs(spark, (2, "B"), (4, "d")))
    log.delete(docs(spark, (3, None)))
    want = {1: "a", 2: "B", 4: "d"}
    now = lambda: {r["doc_id"]: r["text"] for r in log.documents().collect()}
    assert now() == want
    stats = {r["segment"]: (r["doc_count"], r["deleted_count"]) for r in log.stats().collect()}
    assert stats == {1: (3, 2), 2: (2, 0), 3: (1, 1)}
    log.compact()
    assert now() == want and len(log.segments()) == 1


def test_streams(spark, tmp_path):
    source = f"{tmp_path}/in"
    docs(spark, (1, "a"), (2, "b")).write.parquet(source)
    log = DocumentLog(spark, f"{tmp_path}/log")
    for rows in ([(2, "B")], []):
        stream = spark.readStream.schema("doc_id long, text string").parquet(source)
        stream_into(stream, log, f"{tmp_path}/ck").awaitTermination(60)
        if rows:
            docs(spark, *rows).write.mode("append").parquet(source)
    assert {r["doc_id"]: r["text"] for r in log.documents().collect()} == {1: "a", 2: "B"}
    spark.sql("select timestamp'2024-01-01 00:00:01' as at, 'x' as k").write.parquet(f"{tmp_path}/ev")
    counts = windowed_counts(spark.readStream.schema("at timestamp, k string").parquet(f"{tmp_path}/ev"), "at", "1 minute", "10 minutes", "k")
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["count"] for r in spark.table("counts").collect()] == [1]


def test_stream_into_a_log_with_batches(spark, tmp_path):
    """A stream's batches neither replace other segments nor are written twice, before and after a compaction."""
    source, log = f"{tmp_path}/in", DocumentLog(spark, f"{tmp_path}/log")
    now = lambda: {r["doc_id"]: r["text"] for r in log.documents().collect()}
    for i in range(3):
        log.upsert(docs(spark, (i, f"old{i}"), (9, f"nine{i}")))
    docs(spark, (0, "new0"), (20, "t")).write.parquet(source)
    run = lambda: stream_into(spark.readStream.schema("doc_id long, text string").parquet(source), log, f"{tmp_path}/ck").awaitTermination(60)
    run()
    want = {0: "new0", 1: "old1", 2: "old2", 9: "nine2", 20: "t"}
    assert now() == want and len(log.segments()) == 4
    log.compact()
    docs(spark, (9, "later"), (21, "u")).write.mode("append").parquet(source)
    run()
    assert now() == want | {9: "later", 21: "u"} and len(log.segments()) == 2
    batch = log.segments()[1].split("-", 2)[2].rsplit("-", 1)
    log.upsert(docs(spark, (9, "last")))
    assert log.upsert_batch(docs(spark, (9, "again")), batch[0], int(batch[1])) is None and now()[9] == "last"
    log.compact()
    assert log.upsert_batch(docs(spark, (9, "again")), batch[0], int(batch[1])) is None and now()[9] == "last"


def test_late_writer(spark, tmp_path):
    """A writer that claims its version before a compaction and ends after it still counts, and its own deletes stand."""
    log = DocumentLog(spark, f"{tmp_path}/log")
    log.upsert(docs(spark, (1, "a"), (2, "b")))
    version = log.claim()
    log.delete(docs(spark, (2, None)))
    log.compact()
    late = docs(spark, (1, "late"), (2, "late")).selectExpr("*", "false as deleted", f"cast({version} as long) as version")
    log._place(late, f"s-{version:012d}-late")
    assert {r["doc_id"]: r["text"] for r in log.documents().collect()} == {1: "late"}
    log.vacuum()
    assert log.claim() > 3


def test_merge_of_segments(spark, tmp_path):
    log = DocumentLog(spark, f"{tmp_path}/log")
    for i in range(6):
        log.upsert(docs(spark, (i, f"x{i}"), (100, f"y{i}")))
    log.delete(docs(spark, (0, None)))
    want = {i: f"x{i}" for i in range(1, 6)} | {100: "y5"}
    assert log.merge(segments.by_size(log.segment_table())) == [1, 2, 3, 4, 5, 6, 7]
    assert {r["doc_id"]: r["text"] for r in log.documents().collect()} == want and len(log.segments()) < 4


def test_nested_maps(spark):
    rows = spark.sql("select 1L as doc_id, 1L as version, false as deleted, named_struct('m', map('a', 1)) as x union all select 1L, 2L, false, named_struct('m', map('a', 2))")
    assert [r["x"]["m"] for r in live(rows).collect()] == [{"a": 2}]


def test_analyzers_are_kept(spark, tmp_path):
    rows = docs(spark, (1, "The Cat"))
    Store(spark, f"{tmp_path}/a").save(build(rows, {"text": SIMPLE}))
    assert Store(spark, f"{tmp_path}/a").open().analyzers.of("text") == SIMPLE
    with pytest.raises(ValueError):
        Store(spark, f"{tmp_path}/a").open(PerField())
    own = Analyzer(T.ngram_tokenizer(2, 3))
    Store(spark, f"{tmp_path}/b").save(build(rows, {"text": own}))
    with pytest.raises(ValueError):
        Store(spark, f"{tmp_path}/b").open()
    assert Store(spark, f"{tmp_path}/b").open(PerField(by_field={"text": Analyzer(T.ngram_tokenizer(2, 3))})).term_stats.count() > 0


def test_broken_manifest(spark, tmp_path):
    """A commit that died half-way leaves the index as it was."""
    store = Store(spark, f"{tmp_path}/s")
    first = store.save(build(docs(spark, (1, "a cat")), ["text"]))
    store.files.create_new(f"{tmp_path}/s/manifest-{2:012d}.json", '{"version": "v-')
    assert store.manifest()["version"] == first
    assert store.save(build(docs(spark, (2, "dog")), ["text"])) == store.manifest()["version"] != first and store.numbers() == [3, 2, 1]


def test_segments(spark):
    mb = 1 << 20
    rows = [(f"s{i}", s, 100, d, float(i)) for i, (s, d) in enumerate([(mb // 2, 0), (mb // 4, 0), (mb // 8, 40), (50 * mb, 20), (90 * mb, 0)])]
    df = spark.createDataFrame(rows, "segment string, size_bytes long, doc_count long, deleted_count long, created double")
    policy = segments.Policy()
    assert [r["segments"] for r in segments.by_size(df, policy).collect()] == [["s2", "s1", "s0"]]
    assert segments.by_deletion(df, policy).first()["segments"] == ["s2", "s3"]
    assert {r["segment"]: r["t"] for r in df.select("segment", segments.tier(policy).alias("t")).collect()} == {"s0": 0, "s1": 0, "s2": 0, "s3": 3, "s4": 3}
    assert 1 <= segments.balanced(df, 7200.0, policy).count() <= 5 and segments.recommendations(df, policy) == ["merge: most segments are small"]
    assert [r["segment"] for r in segments.deletion_report(df).filter("compact").collect()] == ["s2"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,location.lat,location.lon\n1,2.5,3.5\n")
    assert readers.read_documents(spark, f"{tmp_path}/a.csv").first()["location"]["lon"] == 3.5
    (tmp_path / "a.jsonl").write_text(json.dumps({"id": 1}) + "\n")
    assert readers.read_documents(spark, f"{tmp_path}/a.jsonl").count() == 1
    with pytest.raises(ValueError):
        readers.read_documents(spark, "x", "xml")
    a, b = spark.createDataFrame([(1, "x")], "id long, v string"), spark.createDataFrame([(2, 5, True)], "id long, v long, w boolean")
    both = readers.union_schemaless(a, b)
    assert dict(both.dtypes) == {"id": "bigint", "v": "string", "w": "boolean"} and both.count() == 2
    ids = readers.with_ids(spark.range(100).repartition(7).select(F.col("id").alias("n")), 10)
    assert sorted(r["doc_id"] for r in ids.collect()) == list(range(10, 110))
    (tmp_path / "w.txt").write_text("# words\ncat\n\ndog\n")
    assert [r["word"] for r in readers.read_words(spark, f"{tmp_path}/w.txt").collect()] == ["cat", "dog"]
    (tmp_path / "f.txt").write_text("cat 3\nbad\n")
    assert [tuple(r) for r in readers.read_frequencies(spark, f"{tmp_path}/f.txt").collect()] == [("cat", 3)]
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(readers.as_boolean(F.lit("Yes"), "string")) is True and one(readers.as_boolean(F.lit(0), "int")) is False and one(readers.as_datetime(F.lit(0), "int")).year == 1970


def test_spelling(spark):
    words = spelling.Dictionary(spark.createDataFrame([("search", 50), ("sear", 3), ("query", 20), ("serch", 1)], "word string, freq long"))
    found = spelling.best_suggestions(spelling.suggestions(words.pruned(2), spark.createDataFrame([("saerch",), ("query",)], "query_word string"))).collect()
    by = {(r["query_word"], r["rank"]): (r["word"], r["score"]) for r in found}
    assert by["query", 1] == ("query", 1.0) and by["saerch", 1][0] == "search"
    corrector = spelling.Corrector(words.pruned(2), auto_threshold=0.3)
    fix = corrector.correct("the saerch query")
    assert fix.corrected == "the search query" and fix.auto_corrected and corrector.history == ["the saerch query"]
    unsure = spelling.Correction("saerch", "saerch", 0.6, False, {"saerch": [("search", 0.6)]})
    assert unsure.did_you_mean == "search" and not unsure.should_retry
    assert spelling.Dictionary.minimal(spark).words.count() == 24 and words.with_prefix("sea").count() == 2 and words.top(1).first()["word"] == "search"
    docs_ = spark.createDataFrame([(1, "Search the query"), (2, "")], "doc_id long, text string")
    assert {r[0]: round(r[1], 3) for r in spelling.correctness(docs_, "text", words).collect()} == {1: 0.667, 2: 1.0}
    assert [r["word"] for r in spelling.Dictionary.from_corpus(docs_, "text").words.orderBy("word").collect()] == ["query", "search", "the"]
    hits = {"saerch": 0, "search": 3}
    found, fix = spelling.corrected_search(lambda t: spark.range(hits.get(t, 0)), corrector, "saerch")
    assert found.count() == 3 and fix.corrected == "search"
    some = spelling.Dictionary(spark.createDataFrame([(w, i + 1) for i, w in enumerate("a ab abc bca acb cat cart carts tarc scat xyz é éa".split())], "word string, freq long"))
    asked = spark.createDataFrame([(w,) for w in ("abc", "cta", "a", "éab", "zzzzzz")], "query_word string")
    both = [sorted(map(tuple, spelling.suggestions(some, asked, many=m, keyboard=False).collect())) for m in (False, True)]
    assert both[0] == both[1] and len(both[0]) > 8
    odd = spark.createDataFrame([("aaa",), ("w0rd",), ("strngth",), ("word",)], "w string").select(spelling.might_be_misspelled(F.col("w")).alias("x")).collect()
    assert [r["x"] for r in odd] == [True, True, True, False]
