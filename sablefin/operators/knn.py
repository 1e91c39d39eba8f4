"""Vector search: exact kNN, several query vectors, several fields, metadata filters, IVF, quantisation, re-ranking.

Query vectors are literals in the plan; scoring is one narrow pass over the vectors and the top-k keeps
k rows a task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sablefin.functions import vectors as V


def has_all(column: str, wanted: Mapping[str, str]) -> Column:
    """All key/value pairs are in a map column."""
    test = F.lit(True)
    for k, v in wanted.items():
        test &= F.coalesce(F.col(column)[k] == v, F.lit(False))
    return test


def knn(vectors: DataFrame, query, k: int = 10, metric: str = "cosine", min_similarity: float = 0.0, column: str = "vec", key: str = "doc_id", include_vectors: bool = False) -> DataFrame:
    """(doc_id, distance, score) of the k nearest; ties by id."""
    if k <= 0:
        return vectors.select(F.col(key).alias("doc_id"), F.lit(0.0).alias("distance"), F.lit(0.0).alias("score")).filter(F.lit(False))
    d = V.distance(F.col(column), V.lit_vector(query), metric)
    rows = vectors.select(F.col(key).alias("doc_id"), d.alias("distance"), *([F.col(column).alias("vec")] if include_vectors else []))
    rows = rows.withColumn("score", V.similarity_of(F.col("distance"), metric))
    if min_similarity > 0:
        rows = rows.filter(F.col("score") >= min_similarity)
    return rows.orderBy(F.desc("score"), "distance", "doc_id").limit(k)


def knn_many(vectors: DataFrame, queries, k: int = 10, metric: str = "cosine", column: str = "vec", key: str = "doc_id") -> DataFrame:
    """(query, doc_id, score), k for each row of a small matrix of queries: one matrix product a batch, k rows a query kept in each task."""
    scored = vectors.select(F.col(key).alias("doc_id"), F.posexplode(V.batch_similarity(F.col(column), queries, metric)).alias("query", "score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


@dataclass(frozen=True)
class QueryVector:
    """fields: exact names, prefixes as "name*", or None for the default fields."""

    vector: tuple[float, ...]
    fields: tuple[str, ...] | None = None
    weight: float = 1.0


@dataclass(frozen=True)
class FieldConfig:
    dimension: int = 128
    metric: str = "cosine"
    base_weight: float = 1.0


@dataclass(frozen=True)
class Request:
    queries: tuple[QueryVector, ...]
    k: int = 10
    mode: str = "weighted_sum"
    overfetch: float | None = None
    doc_filter: Mapping[str, str] = field(default_factory=dict)
    field_filter: Mapping[str, str] = field(default_factory=dict)
    min_score: float = 0.0


def selected(wanted: tuple[str, ...] | None, known: Mapping[str, FieldConfig], default: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in default if wanted is None else wanted:
        if name.endswith("*"):
            out += [f for f in known if f.startswith(name[:-1])]
        elif name in known:
            out.append(name)
        else:
            raise ValueError(f"no such vector field: {name}")
    return list(dict.fromkeys(out))


def search(vectors: DataFrame, meta: DataFrame | None, fields: Mapping[str, FieldConfig], request: Request, default_fields: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, score, fields) over vectors (doc_id, field, vec, weight, metadata) and meta (doc_id, metadata).

    Filters come first. All query vectors of a field add up, then fields are merged by document:
    weighted_sum adds, max_sim takes the best. A request with overfetch keeps only each field's best
    k * overfetch hits before that, so a sum may lack the share of a field.
    """
    if request.mode not in ("weighted_sum", "max_sim"):
        raise ValueError(f"mode {request.mode} is not supported")
    if not request.queries:
        raise ValueError("a request needs a query vector")
    if request.overfetch is not None and request.overfetch < 1:
        raise ValueError("overfetch must be 1 or more")
    rows = vectors.filter(has_all("metadata", request.field_filter)) if request.field_filter else vectors
    if request.doc_filter:
        rows = rows.join(meta.filter(has_all("metadata", request.doc_filter)).select("doc_id"), "doc_id", "left_semi")
    wanted: dict[str, list[QueryVector]] = {}
    for q in request.queries:
        for f in selected(q.fields, fields, default_fields or tuple(fields)):
            if len(q.vector) != fields[f].dimension:
                raise ValueError(f"{f} has {fields[f].dimension} dimensions, the query {len(q.vector)}")
            wanted.setdefault(f, []).append(q)
    parts = []
    for f, own in wanted.items():
        each = [q.weight * V.similarity(F.col("vec"), V.lit_vector(q.vector), fields[f].metric) for q in own]
        near = F.array_min(F.array(*[V.distance(F.col("vec"), V.lit_vector(q.vector), fields[f].metric) for q in own]))
        score = sum(each, F.lit(0.0)) * F.col("weight") * fields[f].base_weight
        part = rows.filter(F.col("field") == f).select("doc_id", F.lit(f).alias("field"), near.alias("distance"), score.alias("score"))
        if request.overfetch is not None:
            part = part.orderBy(F.desc("score"), "doc_id").limit(max(1, math.ceil(request.k * request.overfetch)))
        parts.append(part)
    merge = F.sum("score") if request.mode == "weighted_sum" else F.max("score")
    hits = reduce(DataFrame.unionAll, parts).groupBy("doc_id").agg(merge.alias("score"), F.sort_array(F.collect_list(F.struct("field", "score", "distance"))).alias("fields"))
    if request.min_score > 0:
        hits = hits.filter(F.col("score") >= request.min_score)
    return hits.orderBy(F.desc("score"), "doc_id").limit(max(0, request.k))


# IVF


@dataclass
class Ivf:
    """Vectors with their cluster, and the centroids (clusters rows, on the driver)."""

    vectors: DataFrame
    centroids: list[list[float]]
    metric: str = "cosine"
    column: str = "vec"

    def probe(self, query, k: int = 10, probes: int = 10, key: str = "doc_id") -> DataFrame:
        """kNN within the clusters of the nearest centroids; on a table partitioned by cluster only those are read."""
        gap = lambda c: sum((a - b) ** 2 for a, b in zip(c, query, strict=True))
        near = sorted(range(len(self.centroids)), key=lambda i: gap(self.centroids[i]))[:probes]
        return knn(self.vectors.filter(F.col("cluster").isin(near)), query, k, self.metric, column=self.column, key=key)

    def probe_many(self, queries: DataFrame, k: int = 10, probes: int = 10, key: str = "doc_id") -> DataFrame:
        """(query, doc_id, score), k for each row (doc_id, vec) of a table of queries: each meets only the vectors of its nearest clusters, by a join on the cluster."""
        centres = np.asarray(self.centroids)
        probes = min(probes, len(centres))

        def nearest(batches):
            for batch in batches:
                v = np.asarray(batch.column("v").to_pylist(), np.float64).reshape(batch.num_rows, -1)
                gap = (v * v).sum(1)[:, None] - 2 * v @ centres.T + (centres * centres).sum(1)[None, :] if len(v) else np.zeros((0, len(centres)))
                near = np.argpartition(gap, probes - 1, axis=1)[:, :probes] if len(v) else np.zeros((0, probes), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("v"), pa.array(near.tolist(), pa.list_(pa.int32()))], ["query", "v", "clusters"])

        asked = queries.select(F.col(key).cast("long").alias("query"), V.double(F.col(self.column)).alias("v")).mapInArrow(nearest, "query long, v array<double>, clusters array<int>")
        pairs = self.vectors.join(asked.select("query", "v", F.explode("clusters").alias("cluster")), "cluster")
        scored = pairs.select("query", F.col(key).alias("doc_id"), V.similarity(F.col(self.column), F.col("v"), self.metric).alias("score"))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")

    def recall(self, queries: DataFrame, k: int = 10, probes: int = 10, key: str = "doc_id", block: int = 4096) -> tuple[int, float]:
        """Queries (doc_id, vec) and the mean share of their exact k nearest that a probe finds.

        Every query meets every vector, and a task keeps k rows a query. What a probe finds of the exact k nearest is just what lies in
        its clusters: none of the clusters' other vectors is nearer, so no search of its own is needed. Queries come in blocks, so
        neither the driver nor a task ever holds more than one block of them.
        """
        cores = self.vectors.sparkSession.sparkContext.defaultParallelism
        rows = self.vectors.select(F.col(key).cast("long").alias("doc_id"), V.double(F.col(self.column)).alias("v"), "cluster")
        rows = rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
        asked, common = 0, 0
        found = iter(queries.select(V.double(F.col(self.column)).alias("v")).toLocalIterator())
        while held := [r["v"] for r in islice(found, block)]:
            asked += len(held)
            near = nearest_of(rows, np.asarray(held, np.float64), np.asarray(self.centroids), k, min(probes, len(self.centroids)), self.metric)
            common += near.agg(F.count_if("probed")).first()[0]
        return asked, common / max(1, k * asked)

    def cluster_sizes(self) -> DataFrame:
        return self.vectors.groupBy("cluster").agg(F.count("*").alias("n"))

    def plan_rebalance(self, sparse: int, dense: int) -> DataFrame:
        """Which clusters to merge into their neighbour or to split."""
        action = F.when(F.col("n") < sparse, "merge").when(F.col("n") > dense, "split")
        return self.cluster_sizes().withColumn("action", action).filter(F.col("action").isNotNull())


    def rebalanced(self, sparse: int, dense: int, sample: int = 200_000, seed: int = 1) -> Ivf:
        """The plan carried out: dense clusters are split in two (fitted on at most about sample of their rows), sparse ones lose
        their centroid; only vectors of changed clusters get another, the nearest of all that are left."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        plan = {r["cluster"]: (r["action"], r["n"]) for r in self.plan_rebalance(sparse, dense).collect()}  # one row a cluster
        centres: list[list[float] | None] = list(self.centroids)
        live = len(centres)
        for c, (action, n) in sorted(plan.items(), key=lambda x: x[1][1]):
            if action == "merge" and live > 1:
                centres[c], live = None, live - 1
        for c, (action, n) in plan.items():
            if action == "split":
                own = self.vectors.filter(F.col("cluster") == c).select(array_to_vector(V.double(F.col(self.column))).alias("_point"))
                two = KMeans(k=2, seed=seed, featuresCol="_point").fit(own if n <= sample else own.sample(sample / n, seed)).clusterCenters()
                if len(two) == 2:
                    centres[c] = list(map(float, two[0]))
                    centres.append(list(map(float, two[1])))
        ids = [i for i, c in enumerate(centres) if c is not None]
        held = np.asarray([centres[i] for i in ids])

        def nearest(v: pd.Series) -> pd.Series:
            x = np.stack([np.asarray(a, np.float64) for a in v]) if len(v) else np.zeros((0, held.shape[1]))
            return pd.Series(np.asarray(ids)[((held * held).sum(1)[None, :] - 2 * x @ held.T).argmin(axis=1)], dtype="int32")

        moved = F.when(F.col("cluster").isin(list(plan)), F.pandas_udf(nearest, "int")(V.double(F.col(self.column)))).otherwise(F.col("cluster"))
        names = {old: new for new, old in enumerate(ids)}  # numbers follow the list of centroids again
        number = F.element_at(F.array(*[F.lit(names.get(i, -1)) for i in range(len(centres))]), moved + 1)
        return Ivf(self.vectors.withColumn("cluster", number.cast("int")), [centres[i] for i in ids], self.metric, self.column)


def nearest_of(rows: DataFrame, held: np.ndarray, centres: np.ndarray, k: int, probes: int, metric: str) -> DataFrame:
    """(query, doc_id, score, probed): the exact k nearest of rows (doc_id, v, cluster) to each of a block of queries, by its place there;
    ties by id. probed: the row is in one of the query's nearest clusters."""
    gap = (held * held).sum(1)[:, None] - 2 * held @ centres.T + (centres * centres).sum(1)[None, :]
    near = np.zeros(gap.shape, bool)
    np.put_along_axis(near, np.argpartition(gap, probes - 1, axis=1)[:, :probes], True, axis=1)
    score, tile, step = V.scorer(metric), 1024, 16 if V.metric(metric) == "manhattan" else 4096
    out = ["query", "doc_id", "score", "cluster"]

    def run(batches):
        best = [tuple(np.empty(0, t) for t in ("i4", "i8", "f8", "i4")) for _ in range(0, len(held), tile)]  # by query, then best first
        least = np.full(len(held), -np.inf)  # of a query's k so far, the last one's score and id
        last = np.full(len(held), np.iinfo(np.int64).max)
        for batch in batches:
            ids = pc.fill_null(batch.column("doc_id"), np.iinfo(np.int64).min).to_numpy()
            at = batch.column("cluster").to_numpy()
            x = batch.column("v").flatten().to_numpy().reshape(len(ids), -1) if len(ids) else np.zeros((0, held.shape[1]))
            for i in range(0, len(ids), step):
                for j in range(0, len(held), tile):
                    s = score(x[i : i + step], held[j : j + tile])
                    low, own = least[j : j + tile], ids[i : i + step]
                    r, q = np.nonzero((s > low) | ((s == low) & (own[:, None] < last[j : j + tile])))
                    if not len(r):
                        continue
                    old = best[j // tile]
                    every = [np.concatenate(p) for p in zip(old, ((q + j).astype("i4"), own[r], s[r, q], at[i : i + step][r].astype("i4")), strict=True)]
                    order = np.lexsort((every[1], -every[2], every[0]))
                    every = [p[order] for p in every]
                    first = np.searchsorted(every[0], every[0], "left")
                    kept = np.arange(len(first)) - first < k
                    best[j // tile] = every = tuple(p[kept] for p in every)
                    full = np.flatnonzero(np.arange(len(every[0])) - np.searchsorted(every[0], every[0], "left") == k - 1)
                    least[every[0][full]], last[every[0][full]] = every[2][full], every[1][full]
        for part in best:
            yield pa.RecordBatch.from_arrays([*map(pa.array, part), pa.array(near[part[0], part[3]])], [*out, "probed"])

    found = rows.mapInArrow(run, "query int, doc_id long, score double, cluster int, probed boolean")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "doc_id", "score", "probed")


def ivf(vectors: DataFrame, n_rows: int, metric: str = "cosine", column: str = "vec", clusters: int | None = None, seed: int = 1, sample: int = 200_000) -> Ivf:
    """Clusters by k-means (k-means|| start, at most 100 rounds, tolerance 1e-6), fitted on at most about sample rows; every row is assigned."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    clusters = clusters or min(10_000, max(10, round(math.sqrt(max(1, n_rows)))))
    marked = vectors.withColumn("_point", array_to_vector(V.double(F.col(column))))
    some = marked if n_rows <= sample else marked.sample(sample / n_rows, seed)
    model = KMeans(k=clusters, maxIter=100, tol=1e-6, seed=seed, featuresCol="_point", predictionCol="cluster").fit(some)
    return Ivf(model.transform(marked).drop("_point"), [list(map(float, c)) for c in model.clusterCenters()], metric, column)


# Quantisation


def ranges(vectors: DataFrame, column: str = "vec") -> DataFrame:
    """Least and greatest value of each dimension; as many rows as dimensions. A task sends one row of them on."""

    def partial(batches):
        low = high = None
        for batch in batches:
            lists = batch.column("v").drop_null()
            if len(lists):
                m = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
                low = m.min(axis=0) if low is None else np.minimum(low, m.min(axis=0))
                high = m.max(axis=0) if high is None else np.maximum(high, m.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array([low.tolist()]), pa.array([high.tolist()])], ["low", "high"])

    rows = vectors.select(V.double(F.col(column)).alias("v")).mapInArrow(partial, "low array<double>, high array<double>")
    rows = rows.select(F.posexplode(F.arrays_zip("low", "high")).alias("dim", "x"))
    return rows.groupBy("dim").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))


def quantised(vectors: DataFrame, column: str = "vec") -> DataFrame:
    """vectors with codes: 8 bits a dimension between its least and greatest value."""
    bounds = ranges(vectors, column).agg(F.sort_array(F.collect_list(F.struct("dim", "low", "high"))).alias("bounds"))  # one row
    code = F.zip_with(V.double(F.col(column)), F.col("bounds"), lambda x, b: F.when(b["high"] > b["low"], F.round((x - b["low"]) / (b["high"] - b["low"]) * 255)).otherwise(F.lit(0)).cast("int"))
    return vectors.crossJoin(F.broadcast(bounds)).withColumn("codes", code)


def restored(rows: DataFrame) -> DataFrame:
    back = F.zip_with("codes", "bounds", lambda c, b: b["low"] + c / 255 * (b["high"] - b["low"]))
    return rows.withColumn("restored", back)


def compression_ratio(dimension: int, method: str = "scalar8") -> float:
    if method == "product":
        raise NotImplementedError("product quantisation is not offered")
    return 4.0 if method == "scalar8" else 1.0


# Re-ranking


def reranked(hits: DataFrame, method: str = "similarity", boosts: Mapping[tuple[str, str], float] | None = None, normalise: bool = False) -> DataFrame:
    """By similarity, by distance, or by similarity times the boosts of metadata values that match."""
    if method == "distance":
        out = hits.withColumn("score", -F.col("distance"))
    elif method == "weighted":
        factor = F.lit(1.0)
        for (k, v), b in (boosts or {}).items():
            factor = factor * F.when(F.coalesce(F.col("metadata")[k] == v, F.lit(False)), F.lit(float(b))).otherwise(F.lit(1.0))
        out = hits.withColumn("score", F.col("score") * factor)
    elif method == "similarity":
        out = hits
    else:
        raise ValueError(f"no such method: {method}")
    if normalise:
        span = out.agg(F.min("score").alias("low"), F.max("score").alias("high"))
        scaled = F.when(F.col("high") > F.col("low"), (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.col("score"))
        out = out.crossJoin(F.broadcast(span)).withColumn("score", scaled).drop("low", "high")
    return out.orderBy(F.desc("score"), "doc_id")
