"""Secret scans with DataFrame functions only.

Base kinds by pattern, and kind "entropy": in each candidate string a window of WINDOW characters
slides along; the counts of its characters are updated by the entering and the leaving one, and the
Shannon entropy follows from the running sum of c*log2(c). The best window is held against a
threshold of the candidate's character class (hexadecimal, letters and digits, or base 64).
An allow-list suppresses what is no secret: UUIDs, strings without a digit or without a letter, and
placeholders. Candidates that touch a base span are left out; base spans always stay.

Defined cases: null and empty texts have no spans; positions are code points; other columns of the
input, whatever their names, are not read; repeated rows give repeated results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefin.llm.native import SPAN, let, matches, ranked, searchable, written
from sablefin.llm.shared import table

NAMES = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN = NAMES + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]++)"
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
THRESHOLDS = {"hex": 3.0, "alnum": 3.5, "base64": 3.9}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"(?i)example|placeholder|changeme|x{6,}|0{8,}|1234567890",
)


def window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """Bits a character of the window with the highest Shannon entropy; a shorter candidate counts as one window."""
    cost = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])

    def scan(chars):
        zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0.0).cast("double").alias("sum"), F.lit(-1.0).cast("double").alias("best"), F.lit(0).alias("i"))

        def step(acc, c):
            into = F.instr(F.lit(ALPHABET), c) - 1
            leaves = acc["i"] >= window
            out = F.when(leaves, F.instr(F.lit(ALPHABET), F.get(chars, acc["i"] - window)) - 1).otherwise(F.lit(-1))
            added = F.get(acc["n"], into)
            sum_in = acc["sum"] - F.get(cost, added) + F.get(cost, added + 1)
            held = F.get(acc["n"], out) + F.when(out == into, 1).otherwise(0)
            total = F.when(leaves, sum_in - F.get(cost, held) + F.get(cost, held - 1)).otherwise(sum_in)
            counts = F.transform(acc["n"], lambda v, j: v + F.when(j == into, 1).otherwise(0) - F.when(j == out, 1).otherwise(0))
            size = F.least(acc["i"] + 1, F.lit(window))
            bits = F.log2(size.cast("double")) - total / size
            best = F.when((acc["i"] + 1 >= window) | (acc["i"] + 1 == F.size(chars)), F.greatest(acc["best"], bits)).otherwise(acc["best"])
            return F.struct(counts.alias("n"), total.alias("sum"), best.alias("best"), (acc["i"] + 1).alias("i"))

        return F.aggregate(chars, zero, step, lambda acc: acc["best"])

    return let(F.split(candidate, ""), scan)


def suspicious(candidate: Column) -> Column:
    allowed = F.lit(False)
    for rule in ALLOWED:
        allowed = allowed | candidate.rlike(rule)
    needed = (
        F.when(candidate.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit(THRESHOLDS["hex"]))
        .when(candidate.rlike("^[A-Za-z0-9]+$"), F.lit(THRESHOLDS["alnum"]))
        .otherwise(F.lit(THRESHOLDS["base64"]))
    )
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(candidate) >= needed)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, the spans of each base kind, and those of high entropy."""
    text = docs.select("doc_id", searchable(F.col("text")).alias("t"))
    value = lambda x: F.regexp_extract(x["t"], ASSIGN, 1)
    found = text.select(
        "doc_id",
        F.filter(matches(F.col("t"), ASSIGN), lambda x: F.length(value(x)) >= 8).alias("assign"),
        matches(F.col("t"), ACCESS, F.contains("t", F.lit("AKIA"))).alias("access"),
        matches(F.col("t"), HEX).alias("hex"),
        matches(F.col("t"), CANDIDATE).alias("candidates"),
    )
    base = F.concat("assign", "access", "hex")
    new = F.filter("candidates", lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])) & suspicious(x["t"]))
    return found.select("doc_id", "assign", "access", "hex", F.when(F.size("candidates") > 0, new).otherwise(F.array().cast(SPAN)).alias("entropy"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("assign", "access", "hex", "entropy")
    spans = find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds],
        F.array_sort(F.concat(*[ranked(F.col(k), i, k) for i, k in enumerate(kinds)])).alias("all"),
    )
    return spans.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(written(F.filter("all", lambda x: x["k"] < 3)), 256).alias("base_sha256"), written(F.col("all")).alias("spans"), "n_entropy",
    )
