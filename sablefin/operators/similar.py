"""Similarity of documents by their term vectors (raw counts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablefin.functions import scores
from sablefin.operators.index import Index

MOST_LISTED = 2000
ALGORITHMS = ("cosine", "jaccard", "euclidean", "manhattan", "term_frequency", "bm25")


def similar(index: Index, doc_ids: list[int], field: str, algorithm: str = "cosine", min_similarity: float = 0.1, k: int = 20, normalise: bool = True, digits: int | None = None) -> DataFrame:
    """(doc_id, score) of the documents most like the given ones (their summed counts).

    Sums of fractions differ in their last bits with the order of rows, so equal documents may not tie. With digits, scores
    are rounded before the best k are chosen: what is equal to so many digits goes by id.

    Only postings of the given documents' terms are read; what other terms add to a norm was summed when
    the index was built. Documents of more than MOST_LISTED distinct terms take a join in place of the list.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"no such algorithm: {algorithm}")
    query = index.terms_of(doc_ids, field).select("term", F.col("tf").cast("double").alias("q"))
    few = query.limit(MOST_LISTED + 1).collect()
    others = index.postings.filter((F.col("field") == field) & ~F.col("doc_id").isin(doc_ids)).select("doc_id", "term", F.col("tf").cast("double").alias("w"))
    if len(few) <= MOST_LISTED:  # then the terms go to the scan, which reads only their row groups
        others = others.filter(F.col("term").isin([r["term"] for r in few]))
        query = index.spark.createDataFrame([tuple(r) for r in few], "term string, q double")
    sizes = index.norms.filter(F.col("field") == field).select("doc_id", F.col("n_terms").alias("n"), "s1", "s2")
    own = query.agg(F.count("*").alias("qn"), F.coalesce(F.sum("q"), F.lit(0.0)).alias("q1"), F.coalesce(F.sum(F.col("q") * F.col("q")), F.lit(0.0)).alias("q2"))
    joined = others.join(query, "term").crossJoin(F.broadcast(own)).join(sizes, "doc_id")
    l2 = algorithm in ("euclidean", "manhattan", "term_frequency", "bm25") and normalise
    w = F.col("w") / F.sqrt("s2") if l2 else F.col("w")
    q = F.col("q") / F.sqrt("q2") if l2 else F.col("q")
    s1, q1 = (F.col("s1") / F.sqrt("s2"), F.col("q1") / F.sqrt("q2")) if l2 else (F.col("s1"), F.col("q1"))
    first = lambda c: F.first(c)
    by_doc = joined.groupBy("doc_id").agg(
        F.sum(w * q).alias("dot"), F.sum(F.least(w, q)).alias("low"), F.count("*").alias("common"),
        F.sum(w * (scores.K1 + 1) / (w + scores.K1) * q * (scores.K1 + 1) / (q + scores.K1)).alias("bm25"),
        first("n").alias("n"), first("qn").alias("qn"), first(s1).alias("s1"), first(q1).alias("q1"), first("s2").alias("s2"), first("q2").alias("q2"),
    )
    one = F.lit(1.0) if l2 else F.col("s2")
    two = F.lit(1.0) if l2 else F.col("q2")
    total = F.col("s1") + F.col("q1")
    score = {
        "cosine": F.col("dot") / F.sqrt(F.col("s2") * F.col("q2")),
        "jaccard": F.col("common") / (F.col("n") + F.col("qn") - F.col("common")),
        "euclidean": 1 / (1 + F.sqrt(F.greatest(F.lit(0.0), one + two - 2 * F.col("dot")))),
        "manhattan": 1 / (1 + total - 2 * F.col("low")),
        "term_frequency": F.col("low") / (total - F.col("low")),
        "bm25": F.col("bm25"),
    }[algorithm]
    found = by_doc.select("doc_id", score.alias("score")).filter(F.col("score") >= min_similarity)
    if digits is not None:
        found = found.withColumn("score", F.round("score", digits))
    return found.orderBy(F.desc("score"), "doc_id").limit(k)
