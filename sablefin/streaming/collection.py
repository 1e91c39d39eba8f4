"""Vector collections and hybrid ones: add, upsert, delete, count, statistics, compaction, search.

A document is one row of a log: its id, its metadata, and its vectors by field. An upsert replaces all of a
document's vectors. The schema (fields and their dimensions) is a file beside the log that no writer replaces.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefin.operators import knn
from sablefin.streaming.ingest import DocumentLog, Transaction

STRINGS = "map<string,string>"


@dataclass
class VectorCollection:
    """Rows come as doc_id, field, vec and, where there are any, weight and metadata; document metadata as doc_id, metadata."""

    spark: SparkSession
    root: str
    fields: dict[str, knn.FieldConfig] = field(default_factory=dict)
    implicit_schema: bool = False

    def __post_init__(self):
        self.log = DocumentLog(self.spark, f"{self.root}/documents")
        known = [json.loads(self.log.files.read(f"{self.root}/{n}")) for n in self.log.files.names(self.root) if n.startswith("schema-")]
        for fields in known:
            self.fields = {name: knn.FieldConfig(**c) for name, c in fields.items()} | self.fields
        if self.fields and not known:
            self._keep_schema()

    def _keep_schema(self) -> None:
        number = 1
        while not self.log.files.create_new(f"{self.root}/schema-{number:06d}.json", json.dumps({n: asdict(c) for n, c in self.fields.items()})):
            number += 1

    def prepared(self, rows: DataFrame, meta: DataFrame | None = None) -> DataFrame:
        """Documents of the log, checked: known fields, one dimension each, finite numbers. A new field takes the size of its vectors if the schema is implicit."""
        more = {"weight": F.lit(1.0), "metadata": F.create_map().cast(STRINGS)}
        rows = rows.withColumns({n: c for n, c in more.items() if n not in rows.columns})
        odd = F.exists("vec", lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))
        found = rows.groupBy("field").agg(F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high"), F.max(F.coalesce(odd, F.lit(True))).alias("odd")).collect()  # one row a field
        fresh = {}
        for r in found:
            if r["odd"] or r["low"] != r["high"] or r["low"] < 1:
                raise ValueError(f"the vectors of {r['field']} are not all finite and of one size")
            if r["field"] not in self.fields:
                if not self.implicit_schema:
                    raise ValueError(f"no such vector field: {r['field']}")
                fresh[r["field"]] = knn.FieldConfig(dimension=r["low"])
            elif self.fields[r["field"]].dimension != r["low"]:
                raise ValueError(f"{r['field']} has {self.fields[r['field']].dimension} dimensions, the vectors {r['low']}")
        if fresh:
            self.fields |= fresh
            self._keep_schema()
        one = F.struct("field", F.col("vec").cast("array<float>").alias("vec"), F.col("weight").cast("double").alias("weight"), F.col("metadata").cast(STRINGS).alias("metadata"))
        docs = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list(one).alias("vectors"))  # a document's own vectors, one a field
        if meta is None:
            return docs.withColumn("metadata", F.create_map().cast(STRINGS))
        return docs.join(meta.select("doc_id", F.col("metadata").cast(STRINGS).alias("metadata")), "doc_id", "left")

    def next_id(self) -> int:
        if not self.log.segments():
            return 0
        return 1 + (self.log.log().agg(F.max("doc_id")).first()[0] or 0)

    def add(self, rows: DataFrame) -> int:
        """Rows whose doc_id only says which belong together: 0, 1 ... become the next free ids. The first of them is returned."""
        first = self.next_id()
        self.upsert(rows.withColumn("doc_id", F.col("doc_id") + first))
        return first

    def upsert(self, rows: DataFrame, meta: DataFrame | None = None) -> int:
        return self.log.upsert(self.prepared(rows, meta))

    def delete(self, ids: DataFrame) -> int:
        return self.log.delete(ids)

    def documents(self) -> DataFrame:
        return self.log.documents()

    def vectors(self) -> DataFrame:
        """doc_id, field, vec, weight, metadata."""
        return self.documents().select("doc_id", F.explode("vectors").alias("x")).select("doc_id", "x.*")

    def meta(self) -> DataFrame:
        return self.documents().select("doc_id", "metadata")

    def count(self) -> int:
        return self.documents().count() if self.log.segments() else 0

    def stats(self) -> DataFrame:
        """For each field: vectors, documents and dimension."""
        return self.vectors().groupBy("field").agg(F.count("*").alias("vectors"), F.countDistinct("doc_id").alias("documents"), F.max(F.size("vec")).alias("dimension"))

    def optimise(self) -> int:
        """One segment in place of all."""
        return self.log.compact()

    def search(self, request: knn.Request, default_fields: tuple[str, ...] | None = None) -> DataFrame:
        return knn.search(self.vectors(), self.meta(), self.fields, request, default_fields)


@dataclass
class HybridCollection:
    """Documents and their vectors under one id; both sides of a change are seen, or neither."""

    spark: SparkSession
    root: str
    fields: dict[str, knn.FieldConfig] = field(default_factory=dict)
    implicit_schema: bool = False

    def __post_init__(self):
        self.documents = DocumentLog(self.spark, f"{self.root}/lexical")
        self.vectors = VectorCollection(self.spark, f"{self.root}/vector", self.fields, self.implicit_schema)

    @property
    def logs(self) -> Mapping[str, DocumentLog]:
        return {"lexical": self.documents, "vector": self.vectors.log}

    def upsert(self, docs: DataFrame | None = None, rows: DataFrame | None = None, meta: DataFrame | None = None) -> list[int]:
        """Either side may be missing. Vectors that do not fit leave the documents as they were."""
        change = Transaction(self.logs)
        if docs is not None:
            change.upsert("lexical", docs)
        if rows is not None:
            try:
                prepared = self.vectors.prepared(rows, meta)
            except Exception:
                change.abort()
                raise
            change.upsert("vector", prepared)
        return change.commit()

    def delete(self, ids: DataFrame) -> list[int]:
        change = Transaction(self.logs)
        for name in self.logs:
            change.delete(name, ids)
        return change.commit()
