"""Column scans: equality, ranges, frequencies, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_value(rows: DataFrame, column: str, value, key: str = "doc_id") -> DataFrame:
    return rows.filter(F.col(column) == F.lit(value)).select(key)


def in_range(rows: DataFrame, column: str, low=None, high=None, key: str = "doc_id") -> DataFrame:
    test = F.col(column).isNotNull()
    if low is not None:
        test &= F.col(column) >= F.lit(low)
    if high is not None:
        test &= F.col(column) <= F.lit(high)
    return rows.filter(test).select(key)


def frequencies(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))


def statistics(rows: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return rows.agg(F.count("*").alias("rows"), F.count(c).alias("values"), F.count_distinct(c).alias("distinct"), F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"))
