"""Documents and word lists from files, and documents to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None) -> DataFrame:
    """Parquet, JSON lines, whole JSON files or CSV by kind, else by the path's ending; CSV columns a.b become structs."""
    kind = kind or ("json" if path.endswith(("json", "jsonl")) else "csv" if path.endswith("csv") else "parquet")
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        rows = reader.csv(path, header=True, inferSchema=schema is None, multiLine=True, escape='"')
        return nested(rows)
    if kind == "json":
        return reader.json(path)
    if kind == "json_array":
        return reader.json(path, multiLine=True)
    if kind == "parquet":
        return reader.parquet(path)
    raise ValueError(f"no such kind of file: {kind}")


def nested(rows: DataFrame) -> DataFrame:
    """Columns named a.b and a.c as one struct a."""
    groups: dict[str, list[str]] = {}
    for c in rows.columns:
        groups.setdefault(c.split(".", 1)[0], []).append(c)
    out = []
    for head, names in groups.items():
        out.append(F.col(f"`{head}`") if names == [head] else F.struct(*[F.col(f"`{c}`").alias(c.split(".", 1)[1]) for c in names if c != head]).alias(head))
    return rows.select(*out)


def union_schemaless(*frames: DataFrame) -> DataFrame:
    """Documents with different fields in one table; a field of several types becomes text."""
    kinds: dict[str, set[str]] = {}
    for df in frames:
        for name, kind in df.dtypes:
            kinds.setdefault(name, set()).add(kind)
    mixed = [n for n, k in kinds.items() if len(k) > 1]
    out = None
    for df in frames:
        df = df.withColumns({n: F.col(n).cast("string") for n in mixed if n in df.columns})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def with_ids(docs: DataFrame, start: int = 0, key: str = "doc_id") -> DataFrame:
    """Ids without gaps from start, without gathering rows in one task: partition sizes first, then offsets."""
    rows = docs.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    at, first = start, {}
    for p in sorted(sizes):
        first[p] = at
        at += sizes[p]
    offsets = docs.sparkSession.createDataFrame(list(first.items()) or [(0, start)], "_part int, _first long")
    return rows.join(F.broadcast(offsets), "_part").withColumn(key, F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """One word a line; # starts a comment."""
    rows = spark.read.text(path).select(F.trim("value").alias("word"))
    return rows.filter((F.col("word") != "") & ~F.col("word").startswith("#"))


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """word and count on a line, parted by white space."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("word"), F.get(parts, F.lit(1)).cast("long").alias("freq")).filter("freq is not null")


def write_frequencies(words: DataFrame, path: str) -> None:
    words.select(F.concat_ws(" ", "word", F.col("freq").cast("string"))).write.mode("overwrite").text(path)


# Values by kind


def as_text(c: Column, kind: str) -> Column:
    return c if kind == "string" else F.lit(None).cast("string")


def as_number_text(c: Column, kind: str) -> Column:
    return c.cast("string") if kind in ("bigint", "int", "double", "float") else F.lit(None).cast("string")


def as_boolean(c: Column, kind: str) -> Column:
    if kind == "string":
        word = F.lower(c)
        return F.when(word.isin("true", "t", "yes", "y", "1", "on"), F.lit(True)).when(word.isin("false", "f", "no", "n", "0", "off"), F.lit(False))
    return c if kind == "boolean" else c != 0 if kind in ("bigint", "int") else F.lit(None).cast("boolean")


def as_datetime(c: Column, kind: str) -> Column:
    """From RFC 3339 text or epoch seconds."""
    if kind == "string":
        return F.try_to_timestamp(c)
    return F.timestamp_seconds(c) if kind in ("bigint", "int") else c if kind.startswith("timestamp") else F.lit(None).cast("timestamp")
