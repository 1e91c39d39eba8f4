"""The inverted index as tables.

postings    field, term, doc_id, tf, len, positions   (len: the document's field length, kept beside
                                                        each posting so that scoring needs no join)
lengths     field, doc_id, len                         (a row for every document; null without the field)
term_stats  field, term, df, ctf
field_stats field, n, doc_count, avg_len, min_len, max_len   (one row a field)
norms       field, doc_id, n_terms, s1, s2             (distinct terms, sums of tf and of tf squared)

An index that was just built is a set of lazy plans: a filter on terms stops at the tokens, before
the shuffle. A saved index has postings range-partitioned and sorted by field and term, so the same
filter prunes files and row groups; it is made from the terms of documents with one shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K

from sablefin.functions.analyzers import STANDARD, Analyzer, PerField

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

TABLES = ("docs", "postings", "lengths", "term_stats", "field_stats", "norms")


def as_term(column: Column, kind: str) -> Column:
    """The one term of a value that is not text."""
    if kind.startswith("timestamp"):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    if kind.startswith("struct"):
        return F.concat_ws(",", column["lat"].cast("string"), column["lon"].cast("string"))
    return column.cast("string")


def field_tokens(docs: DataFrame, name: str, analyzers: PerField) -> Column:
    kind = docs.schema[name].dataType.simpleString()
    if kind == "string":
        return analyzers.of(name)(F.col(name))
    return F.when(F.col(name).isNotNull(), F.array(as_term(F.col(name), kind)))


@dataclass
class Index:
    docs: DataFrame
    postings: DataFrame
    lengths: DataFrame
    term_stats: DataFrame
    field_stats: DataFrame
    norms: DataFrame
    fields: tuple[str, ...]
    analyzers: PerField = field(default_factory=PerField)
    terms: DataFrame | None = None  # field, doc_id, terms: of an index just built

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    def stats(self, name: str) -> DataFrame:
        """One row: n, avg."""
        return self.field_stats.filter(F.col("field") == name).select("n", F.col("avg_len").alias("avg"))

    def of_term(self, name: str, term: str) -> DataFrame:
        return self.postings.filter((F.col("field") == name) & (F.col("term") == term))

    def all_ids(self) -> DataFrame:
        return self.docs.select("doc_id")

    def term_vector(self, doc_id: int, name: str) -> DataFrame:
        return self.postings.filter((F.col("field") == name) & (F.col("doc_id") == doc_id)).select("term", "tf", "positions")

    def terms_of(self, doc_ids, name: str) -> DataFrame:
        """(term, tf) of the given documents together, analysed from the stored rows: postings are not kept by document."""
        rows = self.docs.filter(F.col("doc_id").isin(list(doc_ids)))
        return rows.select(F.explode(field_tokens(rows, name, self.analyzers)).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))

    def summary(self) -> DataFrame:
        """Counts of documents, terms and postings, one row."""
        return self.docs.agg(F.count("*").alias("n_docs")).crossJoin(self.term_stats.agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"), F.sum("ctf").alias("n_tokens")))

    def cached(self) -> Index:
        """The same index with its tables kept in memory, spilling to disk."""
        return replace(self, **{t: getattr(self, t).persist() for t in TABLES})


def build(docs: DataFrame, fields: Mapping[str, Analyzer] | list[str], key: str = "doc_id") -> Index:
    """An index over text columns (with their analyzers) and other columns (one term a value)."""
    by_field = dict(fields) if isinstance(fields, Mapping) else dict.fromkeys(fields, STANDARD)
    docs = docs.withColumnRenamed(key, "doc_id") if key != "doc_id" else docs
    analyzers = PerField(by_field={k: v for k, v in by_field.items() if v is not None})
    terms = [docs.select(F.lit(f).alias("field"), "doc_id", field_tokens(docs, f, analyzers).alias("terms")) for f in by_field]
    terms = reduce(DataFrame.unionAll, terms)
    lengths = terms.select("field", "doc_id", F.when(F.col("terms").isNotNull(), F.size("terms")).alias("len"))
    tokens = terms.select("field", "doc_id", F.size("terms").alias("len"), F.posexplode("terms").alias("pos", "term"))
    postings = tokens.groupBy("field", "term", "doc_id", "len").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    term_stats = tokens.groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf")).groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf"))
    counted = postings.select("field", "term", "doc_id", "tf", "len", "positions")
    return Index(docs, counted, lengths, term_stats, field_stats_of(lengths), norms_of(counted), tuple(by_field), analyzers, terms)


def field_stats_of(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("field").agg(F.count("*").alias("n"), F.count("len").alias("doc_count"), F.avg("len").alias("avg_len"), F.min("len").alias("min_len"), F.max("len").alias("max_len"))


def norms_of(postings: DataFrame) -> DataFrame:
    w = F.col("tf").cast("double")
    return postings.groupBy("field", "doc_id").agg(F.count("*").alias("n_terms"), F.sum(w).alias("s1"), F.sum(w * w).alias("s2"))


# Whole tables from the documents' terms, for a saved index. A document's postings are counted where it is read, so that only
# one shuffle is left: of blocks, which hold a term's postings in a batch of documents.


def counted_terms(batch: pa.RecordBatch):
    """Of a batch (field, doc_id, terms): the lengths; the distinct terms; and by term and row the starts of its (term, row) pairs among the positions, with each pair's term and row."""
    lists = batch.column("terms")
    lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    known = lists.flatten().dictionary_encode(null_encoding="encode")
    codes = known.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    order = np.argsort(codes, kind="stable")  # rows and positions keep their order within a term
    rows = np.repeat(np.arange(len(lens), dtype=np.int32), lens)[order]
    at = (np.arange(len(codes)) - np.repeat(np.cumsum(lens) - lens, lens))[order].astype(np.int32)
    codes = codes[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])
    starts = np.flatnonzero(new)
    return lens, known.dictionary, at, starts, codes[starts], rows[starts]


def sizes_of(terms: DataFrame) -> DataFrame:
    """(field, doc_id, len, n_terms, s1, s2), a row for each row of terms; len is null without the field."""

    def run(batches):
        for batch in batches:
            lens, _, at, starts, _, rows = counted_terms(batch)
            tf = np.diff(np.append(starts, len(at))).astype(np.float64)
            n = np.bincount(rows, minlength=len(lens)).astype(np.int64)
            s2 = np.bincount(rows, weights=tf * tf, minlength=len(lens)).astype(np.float64)
            length = pa.array(lens.astype(np.int32), mask=pc.is_null(batch.column("terms")).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("field"), batch.column("doc_id"), length, pa.array(n), pa.array(lens.astype(np.float64)), pa.array(s2)], ["field", "doc_id", "len", "n_terms", "s1", "s2"])

    key = terms.schema["doc_id"].dataType
    return terms.mapInArrow(run, K.StructType([K.StructField("field", K.StringType()), K.StructField("doc_id", key), *K._parse_datatype_string("len int, n_terms long, s1 double, s2 double").fields]))


def blocks_of(terms: DataFrame, splits: Mapping[str, tuple[int, list[str]]]) -> DataFrame:
    """(part, field, term, ids, lens, starts, positions): a term's documents in a batch, with the start of each one's positions, and the end.

    splits: for each field its first part, and the terms that end one part and begin the next. A term that is listed several
    times has several parts, and its blocks are dealt to them in turn.
    """

    def run(batches):
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id")
            order = pc.sort_indices(ids).to_numpy()
            if (order[1:] < order[:-1]).any():
                batch = batch.take(pa.array(order))
                ids = batch.column("doc_id")
            name = batch.column("field")[0].as_py()
            lens, known, at, starts, codes, rows = counted_terms(batch)
            new = np.ones(len(codes), bool)
            new[1:] = codes[1:] != codes[:-1]
            first = np.append(np.flatnonzero(new), len(codes))  # of each term among the pairs
            ends = np.append(starts, len(at))
            base = ends[first]  # of each term among the positions
            term = known.take(pa.array(codes[first[:-1]]))
            low, cuts = splits[name]
            words, cuts = np.array([w or "" for w in term.to_pylist()], object), np.array(cuts, object)
            left, right = np.searchsorted(cuts, words, "left"), np.searchsorted(cuts, words, "right")
            part = (low + left + turn % (right - left + 1)).astype(np.int32)
            turn += 1
            pairs = np.diff(first)
            ends_at = np.arange(len(starts)) + np.repeat(np.arange(len(pairs)), pairs)  # one more entry a term, for the end of its last pair
            inner = np.empty(len(starts) + len(pairs), np.int32)
            inner[ends_at] = starts - np.repeat(base[:-1], pairs)
            inner[first[1:] + np.arange(len(pairs))] = np.diff(base)
            lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
            columns = [pa.array(part), pa.array([name] * len(part), pa.string()), term, lists(first, ids.take(pa.array(rows))), lists(first, pa.array(lens[rows].astype(np.int32))), lists(first + np.arange(len(first)), pa.array(inner)), lists(base, pa.array(at))]
            out = pa.RecordBatch.from_arrays(columns, ["part", "field", "term", "ids", "lens", "starts", "positions"])
            for i in range(0, len(part), 20_000):
                yield out.slice(i, 20_000)

    key = terms.schema["doc_id"].dataType.simpleString()
    return terms.mapInArrow(run, f"part int, field string, term string, ids array<{key}>, lens array<int>, starts array<int>, positions array<int>")


def unpacked(blocks: DataFrame) -> DataFrame:
    """Postings from blocks, in their order."""

    def run(batches):
        for batch in batches:
            ids, lens, starts, positions = (batch.column(c) for c in ("ids", "lens", "starts", "positions"))
            pairs = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
            if not pairs.sum():
                continue
            block = np.repeat(np.arange(len(pairs)), pairs)
            held = starts.flatten().to_numpy(zero_copy_only=False)
            at = np.arange(len(block)) + block  # starts have one more entry a block
            tf = (held[at + 1] - held[at]).astype(np.int32)
            offsets = np.append(0, np.cumsum(tf)).astype(np.int32)
            columns = [batch.column("field").take(pa.array(block)), batch.column("term").take(pa.array(block)), ids.flatten(), pa.array(tf), lens.flatten(), pa.ListArray.from_arrays(pa.array(offsets), positions.flatten())]
            out = pa.RecordBatch.from_arrays(columns, ["field", "term", "doc_id", "tf", "len", "positions"])
            for i in range(0, len(block), 50_000):
                yield out.slice(i, 50_000)

    key = blocks.schema["ids"].dataType.elementType.simpleString()
    return blocks.mapInArrow(run, f"field string, term string, doc_id {key}, tf int, len int, positions array<int>")


PAIRS_A_FILE = 2_000_000
SAMPLED = 4_000  # documents; they decide where files begin and end, and nothing else


def laid_out(index: Index, sizes: DataFrame, least: int) -> DataFrame:
    """Postings by range of (field, term), sorted by them, in as many files as they need; a term's documents come in sorted runs. sizes: as written."""
    held = {r["field"]: (r["n"], r["pairs"]) for r in sizes.groupBy("field").agg(F.count("*").alias("n"), F.sum("n_terms").alias("pairs")).collect()}  # one row a field
    total = max(1, sum(p for _, p in held.values()))
    files = max(least, -(-total // PAIRS_A_FILE))
    splits: dict[str, tuple[int, list[str]]] = {}
    low = 0
    for name in index.fields:
        n, pairs = held.get(name, (0, 0))
        parts = max(1, round(files * pairs / total))
        some = index.docs.sample(min(1.0, SAMPLED / n), 1) if n > SAMPLED else index.docs  # before the analysis
        counts = some.select(F.explode(F.array_distinct(field_tokens(some, name, index.analyzers))).alias("term")).groupBy("term").count().collect() if parts > 1 else []
        counts = sorted((r["term"] or "", r["count"]) for r in counts)
        ends = np.cumsum([c for _, c in counts])
        cuts = [counts[int(np.searchsorted(ends, ends[-1] * i / parts, "left"))][0] for i in range(1, parts)] if counts else []
        splits[name] = (low, cuts)
        low += len(cuts) + 1
    blocks = reduce(DataFrame.unionAll, [blocks_of(index.terms.filter(F.col("field") == f), splits) for f in index.fields])
    dealt = blocks.repartitionById(low, "part").sortWithinPartitions("field", "term", F.get("ids", F.lit(0)))
    return unpacked(dealt)
