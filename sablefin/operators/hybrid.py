"""Lexical and vector hits in one ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NORMALISATIONS = ("none", "minmax", "zscore", "rank")


def normalised(hits: DataFrame, how: str = "minmax") -> DataFrame:
    """(doc_id, raw, norm). Without spread the raw scores stay. Counts and bounds are one-row tables; ranks are over distinct scores."""
    s = F.col("score")
    if how == "none":
        return hits.select("doc_id", s.alias("raw"), s.alias("norm"))
    if how == "rank":  # over distinct scores, few for hits after a limit
        distinct = hits.select("score").distinct()
        order = distinct.withColumn("place", F.dense_rank().over(Window.orderBy(F.desc("score"))) - 1)
        place = order.crossJoin(F.broadcast(distinct.agg(F.count("*").alias("of"))))
        return hits.join(place, "score").select("doc_id", s.alias("raw"), (1 - F.col("place") / F.col("of")).alias("norm"))
    one = hits.agg(F.min(s).alias("low"), F.max(s).alias("high"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("sd"))
    if how == "minmax":
        norm = F.when(F.col("high") > F.col("low"), (s - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(s)
    elif how == "zscore":
        norm = F.when(F.col("sd") > 0, ((s - F.col("mean")) / F.col("sd") + 3) / 6).otherwise(s)
    else:
        raise ValueError(f"no such normalisation: {how}")
    return hits.crossJoin(F.broadcast(one)).select("doc_id", s.alias("raw"), norm.alias("norm"))


def fused(keyword: Column, vector: Column, method: str, weights: tuple[float, float], n_keyword: Column, n_vector: Column, place: tuple[Column, Column]) -> Column:
    k, v = F.coalesce(keyword, F.lit(0.0)), F.coalesce(vector, F.lit(0.0))
    if method == "weighted_sum":
        return weights[0] * k + weights[1] * v
    if method == "harmonic_mean":
        return F.when((k > 0) & (v > 0), 2 * k * v / (k + v)).otherwise(F.lit(0.0))
    part = lambda w, x, bottom: F.when(x.isNotNull(), w / bottom).otherwise(F.lit(0.0))
    if method == "rrf":  # the normalised score gives the pseudo-rank
        return part(weights[0], keyword, 60 + (1 - keyword) * n_keyword) + part(weights[1], vector, 60 + (1 - vector) * n_vector)
    if method == "rrf_rank":
        return part(weights[0], keyword, 60 + place[0]) + part(weights[1], vector, 60 + place[1])
    raise ValueError(f"no such combination: {method}")


def combine(
    keyword: DataFrame, vector: DataFrame, normalisation: str = "minmax", method: str = "weighted_sum", weights: tuple[float, float] = (0.5, 0.5), k: int = 10,
    require_both: bool = False, min_keyword: float | None = None, min_vector: float | None = None, min_score: float | None = None, rescale: bool = False,
) -> DataFrame:
    """(doc_id, keyword_score, vector_score, score) of two sets of hits (doc_id, score), each cut to its top results before."""
    keyword = keyword if min_keyword is None else keyword.filter(F.col("score") >= min_keyword)
    vector = vector if min_vector is None else vector.filter(F.col("score") >= min_vector)
    sides = []
    for df, tag in ((keyword, "k"), (vector, "v")):
        own = normalised(df.select("doc_id", "score"), normalisation)
        if method == "rrf_rank":
            own = own.withColumn("place", F.row_number().over(Window.orderBy(F.desc("raw"), "doc_id")).cast("double"))  # hits are cut to k before
        else:
            own = own.withColumn("place", F.lit(None).cast("double"))
        sides.append(own.select("doc_id", *[F.col(c).alias(f"{tag}_{c}") for c in ("raw", "norm", "place")]))
    rows = sides[0].join(sides[1], "doc_id", "inner" if require_both else "full_outer")
    sizes = keyword.agg(F.count("*").alias("nk")).crossJoin(vector.agg(F.count("*").alias("nv")))
    rows = rows.crossJoin(F.broadcast(sizes))
    score = fused(F.col("k_norm"), F.col("v_norm"), method, weights, F.col("nk"), F.col("nv"), (F.col("k_place"), F.col("v_place")))
    out = rows.select("doc_id", F.col("k_raw").alias("keyword_score"), F.col("v_raw").alias("vector_score"), score.alias("score"))
    if rescale:
        top = out.agg(F.max("score").alias("top"))
        out = out.crossJoin(F.broadcast(top)).withColumn("score", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(F.col("score"))).drop("top")
    if min_score is not None:
        out = out.filter(F.col("score") >= min_score)
    return out.orderBy(F.desc("score"), "doc_id").limit(k)


def coverage(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """How many documents came from each side and from both."""
    both = keyword.select("doc_id", F.lit(1).alias("k")).join(vector.select("doc_id", F.lit(1).alias("v")), "doc_id", "full_outer")
    return both.agg(F.count("k").alias("keyword"), F.count("v").alias("vector"), F.count_if(F.col("k").isNotNull() & F.col("v").isNotNull()).alias("both"))
