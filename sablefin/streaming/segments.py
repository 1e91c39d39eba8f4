"""Which segments to merge: plans over a table of segment statistics.

segments: segment, size_bytes, doc_count, deleted_count, created (seconds). Nothing is moved here;
a plan is rows (strategy, group, segments, priority).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    max_segments: int = 10
    min_size: int = 1 << 20
    max_size: int = 100 << 20
    per_tier: int = 4
    max_deleted: float = 0.3


def tier(policy: Policy):
    size = F.col("size_bytes")
    return F.when(size < policy.min_size, 0).when(size < policy.max_size // 4, 1).when(size < policy.max_size // 2, 2).otherwise(3)


def deleted_ratio():
    return F.when(F.col("doc_count") > 0, F.col("deleted_count") / F.col("doc_count")).otherwise(F.lit(0.0))


def deletion_report(segments: DataFrame, policy: Policy = Policy()) -> DataFrame:
    return segments.select("segment", deleted_ratio().alias("ratio"), (deleted_ratio() > policy.max_deleted).alias("compact"))


def batches(rows: DataFrame, order, size: int, strategy: str, priority) -> DataFrame:
    """Rows in batches of size by an order; the table of segments is small (one row a segment)."""
    ranked = rows.withColumn("n", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("group", F.floor(F.col("n") / size).cast("int"))
    out = ranked.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("n", "segment"))).alias("s"), F.count("*").alias("count"), priority.alias("priority"))
    return out.select(F.lit(strategy).alias("strategy"), "group", F.transform("s", lambda x: x["segment"]).alias("segments"), "count", "priority")


def by_size(segments: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Small segments, smallest first, a tier's number together."""
    small = segments.filter(F.col("size_bytes") < policy.min_size)
    weight = F.avg(1 - F.col("size_bytes") / policy.min_size) * F.count("*")
    return batches(small, ["size_bytes", "segment"], policy.per_tier, "size", weight).filter("count > 1")


def by_deletion(segments: DataFrame, policy: Policy = Policy()) -> DataFrame:
    many = segments.filter(deleted_ratio() > policy.max_deleted / 2)
    return batches(many, [deleted_ratio().desc(), "segment"], policy.per_tier, "deletion", F.avg(deleted_ratio()) * 10 * F.count("*"))


def by_time(segments: DataFrame, now: float, policy: Policy = Policy()) -> DataFrame:
    age = (F.lit(now) - F.avg("created")) / 3600
    return batches(segments, ["created", "segment"], policy.per_tier, "time", age * F.count("*")).filter("count > 1")


def balanced(segments: DataFrame, now: float, policy: Policy = Policy(), most: int = 5) -> DataFrame:
    every = by_size(segments, policy).unionByName(by_deletion(segments, policy)).unionByName(by_time(segments, now, policy))
    return every.orderBy(F.desc("priority"), "strategy", "group").limit(most)


def recommendations(segments: DataFrame, policy: Policy = Policy()) -> list[str]:
    """From one row of sums."""
    r = segments.agg(F.count("*").alias("n"), F.sum("doc_count").alias("docs"), F.sum("deleted_count").alias("gone"), F.count_if(F.col("size_bytes") < policy.min_size).alias("small")).first()
    out = []
    if r["n"] > policy.max_segments:
        out.append("merge: more segments than the policy allows")
    if r["docs"] and r["gone"] / r["docs"] > policy.max_deleted:
        out.append("compact: many documents are deleted")
    if r["n"] and r["small"] / r["n"] > 0.5:
        out.append("merge: most segments are small")
    return out
