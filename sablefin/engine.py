"""One entry point over documents, vectors and both."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from sablefin.functions.analyzers import PerField
from sablefin.operators import hybrid, knn, results
from sablefin.operators.index import Index, build
from sablefin.plans import ast as A
from sablefin.plans.compile import hits
from sablefin.plans.parser import Parser
from sablefin.sources.store import Store


@dataclass
class Engine:
    """Lexical search over an index, vector search over a table of vectors, and hybrid search."""

    index: Index | None = None
    vectors: DataFrame | None = None
    meta: DataFrame | None = None
    vector_fields: Mapping[str, knn.FieldConfig] = field(default_factory=dict)
    default_fields: tuple[str, ...] = ()

    @classmethod
    def over(cls, docs: DataFrame, fields, **kwargs) -> Engine:
        return cls(index=build(docs, fields), **kwargs)

    @classmethod
    def open(cls, spark: SparkSession, path: str, analyzers: PerField | None = None, **kwargs) -> Engine:
        return cls(index=Store(spark, path).open(analyzers), **kwargs)

    def parse(self, text: str, compat: bool = False) -> A.Query:
        known: dict[tuple[str, str], list[str]] = {}

        def analyse(name: str, x: str) -> list[str]:
            if (name, x) not in known:
                known[name, x] = self.index.analyzers.of(name).terms(self.index.spark, x)
            return known[name, x]

        return Parser(analyse, self.default_fields or self.index.fields, compat).parse(text)

    def hits(self, query: A.Query | str) -> DataFrame:
        return hits(self.parse(query) if isinstance(query, str) else query, self.index)

    def search(self, query: A.Query | str, k: int = 10, min_score: float | None = None, sort_by: str | None = None, descending: bool = False, load: bool = True) -> DataFrame:
        """The k best hits, with the stored fields where load is set."""
        found = self.hits(query)
        if sort_by:
            found = found if min_score is None else found.filter(found["score"] >= min_score)
            top = results.top_by_field(found, self.index.docs, sort_by, k, descending)
        else:
            top = results.top_k(found, k, min_score)
        return results.fetch(top, self.index.docs) if load else top

    def count(self, query: A.Query | str) -> int:
        return results.count(self.hits(query))

    def vector_search(self, request: knn.Request) -> DataFrame:
        return knn.search(self.vectors, self.meta, self.vector_fields, request, self.default_fields or None)

    def hybrid_search(self, query: A.Query | str, request: knn.Request, k: int = 10, depth: int = 100, **how) -> DataFrame:
        """Each side's best `depth` results, combined."""
        from dataclasses import replace

        keyword = results.top_k(self.hits(query), depth)
        vector = self.vector_search(replace(request, k=depth)).select("doc_id", "score")
        return hybrid.combine(keyword, vector, k=k, **how)

    def save(self, path: str) -> str:
        return Store(self.index.spark, path).save(self.index)
