"""The corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of docs. A stage's result is written as Parquet to the shared folder and read again, so a lost
executor costs no more than its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefin.llm import decontaminate, language, lines, minhash, packing
from sablefin.llm.shared import WORD, materialise, table

MIN_GAIN = 0.15  # of the way from chance to certainty
ORACLE_SQL = None  # training, sketching and tokenizing have no SQL form


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those whose best language is hardly better than chance (MIN_GAIN).

    A null or empty text goes; a null doc_id or other columns decide nothing; repeated rows share their fate; without
    any labelled row there is no model and everything goes; an empty table stays one.
    """
    return language.accepted(docs, *language.fit(language.training_rows(docs)), min_gain=MIN_GAIN)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines with an earlier match; a document that loses its last word goes.

    A row with a null doc_id or text passes as it is; rows of one doc_id count as one document, whose equal line numbers
    never match each other; n_chars, where there is such a column, follows the cut.
    """
    others = {c: f"column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # whatever their names
    cut = lines.line_dedup(docs.withColumnsRenamed(others))
    left = cut.filter((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    if n := others.get("n_chars"):
        left = left.withColumn(n, F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(n)).cast(docs.schema["n_chars"].dataType))
    return left.select(*[F.col(others.get(c, c)).alias(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more.

    A text that is null or has no word is like no other and stays, as does a row with a null doc_id; all rows of the
    smallest doc_id of a group stay, those of the others go.
    """
    gone = minhash.near_duplicates(docs, words=5, percent=80).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    gone = materialise(gone, "near-gone")
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or in large part, go.

    Null and empty texts hold none and stay, as does everything where the benchmark is empty.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; a null or empty text is its end id alone, a null doc_id is carried as null."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
