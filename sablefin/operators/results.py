"""What is done with hits: top-k, sorting, facets, groups, aggregations, snippets, retrieval."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(hits: DataFrame, k: int = 10, min_score: float | None = None) -> DataFrame:
    """Best scores first; ties by document."""
    kept = hits if min_score is None else hits.filter(F.col("score") >= min_score)
    return kept.orderBy(F.desc("score"), "doc_id").limit(k)


def fetch(hits: DataFrame, docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Stored columns of the hits. Hits cut to k rows are small enough for the planner to broadcast them; others are joined as they come."""
    wanted = docs.select("doc_id", *(c for c in (columns or docs.columns) if c not in ("doc_id", "score")))
    return wanted.join(hits, "doc_id")


def sort_key(column: Column, descending: bool) -> Column:
    return column.desc_nulls_first() if descending else column.asc_nulls_last()


def top_by_field(hits: DataFrame, docs: DataFrame, field: str, k: int = 10, descending: bool = False) -> DataFrame:
    """Ascending: nulls last; descending: nulls first; ties by document."""
    value = docs.select("doc_id", F.col(field).alias("sort_value"))
    return hits.join(value, "doc_id").orderBy(sort_key(F.col("sort_value"), descending), "doc_id").limit(k)


# The order of kinds in a column of mixed values.
KIND_ORDER = ("text", "integer", "float", "boolean", "geo", "datetime", "binary", "vector", "null")


def kind_rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), kind)


def count(hits: DataFrame) -> int:
    return hits.count()


def summary(hits: DataFrame) -> DataFrame:
    """total_hits and max_score of all hits, one row."""
    return hits.agg(F.count("*").alias("total_hits"), F.max("score").alias("max_score"))


# Facets


def facet(rows: DataFrame, field: str, size: int = 100, min_count: int = 1, by: str = "count") -> DataFrame:
    """Counts of a field's values among rows; by: count (most first) or value."""
    counts = rows.filter(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("value")).agg(F.count("*").alias("count"))
    order = [F.desc("count"), "value"] if by == "count" else ["value"]
    return counts.filter(F.col("count") >= min_count).orderBy(*order).limit(size)


def prefixes(path: Column, delimiter: str = "/", depth: int = 10) -> Column:
    """A path and its ancestors, shortest first, at most depth levels."""
    parts = F.filter(F.split(path, F.lit(f"\\Q{delimiter}\\E"), F.lit(-1)), lambda p: p != "")
    return F.transform(F.slice(parts, 1, depth), lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), delimiter))


def path_facet(rows: DataFrame, field: str, delimiter: str = "/", depth: int = 10, size: int = 100) -> DataFrame:
    """Counts of each path and each of its ancestors, which is a roll-up over path prefixes."""
    # Equal paths are summed first, so the explosion is over distinct paths and not over rows.
    paths = rows.filter(F.col(field).isNotNull()).groupBy(F.col(field).alias("path")).agg(F.count("*").alias("n"))
    each = paths.select(F.explode(prefixes(F.col("path"), delimiter, depth)).alias("value"), "n")
    return each.groupBy("value").agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "value").limit(size)


def path_depth(path: Column, delimiter: str = "/") -> Column:
    return F.size(F.filter(F.split(path, F.lit(f"\\Q{delimiter}\\E"), F.lit(-1)), lambda p: p != ""))


def path_parent(path: Column, delimiter: str = "/") -> Column:
    """Null at the root."""
    parts = F.filter(F.split(path, F.lit(f"\\Q{delimiter}\\E"), F.lit(-1)), lambda p: p != "")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), delimiter))


def path_within(path: Column, ancestor: str, delimiter: str = "/") -> Column:
    """The path itself or below it."""
    return (path == ancestor) | path.startswith(ancestor + delimiter)


def facet_filter(rows: DataFrame, field: str, required: list[str] = (), excluded: list[str] = (), delimiter: str = "/") -> DataFrame:
    test = F.lit(True)
    for p in required:
        test &= path_within(F.col(field), p, delimiter)
    for p in excluded:
        test &= ~F.coalesce(path_within(F.col(field), p, delimiter), F.lit(False))
    return rows.filter(test)


def merged_facets(*facets: DataFrame) -> DataFrame:
    out = facets[0]
    for f in facets[1:]:
        out = out.unionByName(f)
    return out.groupBy("value").agg(F.sum("count").alias("count"))


@dataclass(frozen=True)
class Bucket:
    """[low, high); an open end is None."""

    low: float | None
    high: float | None

    @property
    def label(self) -> str:
        return f"[{'*' if self.low is None else f'{self.low:g}'} TO {'*' if self.high is None else f'{self.high:g}'})"


def equal_buckets(low: float, high: float, n: int) -> list[Bucket]:
    """n equal ranges, the last open to the right."""
    step = (high - low) / n
    return [Bucket(low + i * step, low + (i + 1) * step if i < n - 1 else None) for i in range(n)]


def range_facet(rows: DataFrame, field: str, buckets: list[Bucket]) -> DataFrame:
    """One pass: a conditional count for each bucket, then a row for each, zero counts too. Overlapping buckets each count."""
    v = F.col(field)
    tests = []
    for b in buckets:
        test = v.isNotNull()
        if b.low is not None:
            test &= v >= b.low
        if b.high is not None:
            test &= v < b.high
        tests.append(test)
    one = rows.agg(*[F.count_if(t).alias(f"b{i}") for i, t in enumerate(tests)])
    listed = F.array(*[F.struct(F.lit(i).alias("bucket"), F.lit(b.label).alias("value"), F.col(f"b{i}").alias("count")) for i, b in enumerate(buckets)])
    return one.select(F.inline(listed))


# Groups and aggregations


def grouped(hits: DataFrame, docs: DataFrame, field: str, per_group: int = 10, max_groups: int = 100, missing: str = "unknown") -> DataFrame:
    """The best hits of each group, with its size, its best score and its rank among groups."""
    key = F.coalesce(F.col(field).cast("string"), F.lit(missing)).alias("group")
    rows = hits.join(docs.select("doc_id", key), "doc_id")
    groups = rows.groupBy("group").agg(F.count("*").alias("group_count"), F.max("score").alias("best"))
    top = F.broadcast(groups.orderBy(F.desc("best"), "group").limit(max_groups))  # max_groups rows
    order = Window.partitionBy("group").orderBy(F.desc("score"), "doc_id")
    ranked = rows.join(top, "group").withColumn("rank", F.row_number().over(order))  # a rank limit on row_number is applied before the shuffle too
    return ranked.filter(F.col("rank") <= per_group)


def result_groups(hits: DataFrame, docs: DataFrame, field: str, missing: str = "[no value]") -> DataFrame:
    """Key, total and best score of every group."""
    key = F.coalesce(F.col(field).cast("string"), F.lit(missing)).alias("group")
    return hits.join(docs.select("doc_id", key), "doc_id").groupBy("group").agg(F.count("*").alias("total"), F.max("score").alias("max_score")).orderBy("group")


def statistics(rows: DataFrame, field: str) -> DataFrame:
    v = F.col(field)
    return rows.agg(F.count(v).alias("count"), F.sum(v).alias("sum"), F.avg(v).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max"))


def date_histogram(rows: DataFrame, field: str, interval: str = "month") -> DataFrame:
    """Counts by calendar unit, or by fixed windows where interval is a duration such as "6 hours"."""
    at = F.window(F.col(field), interval)["start"] if " " in interval else F.date_trunc(interval, F.col(field))
    return rows.filter(F.col(field).isNotNull()).groupBy(at.alias("bucket")).agg(F.count("*").alias("count")).orderBy("bucket")


def value_frequencies(rows: DataFrame, field: str) -> DataFrame:
    return rows.groupBy(F.col(field).alias("value")).agg(F.count("*").alias("count"))


def retrieved(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Fields as strings; "*" is all of them."""
    names = rows.columns if fields == ["*"] else fields
    return rows.select(*[F.col(c).cast("string").alias(c) for c in names])


def snippet(text: Column, length: int = 150) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)
