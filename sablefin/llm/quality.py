"""Quality rules with DataFrame functions only.

Base rules count what is plainly wrong with a text. The verdict is a log-likelihood ratio: words and
word pairs are hashed into BUCKETS features, one multinomial is counted over trusted documents (good and not toxic) and
one over the whole corpus, and a document's mean log ratio a feature must reach THRESHOLD. The
trusted sample (at most TRUSTED labelled ids, by hash order) is the only sample; the corpus counts
and the scores cover every word of every document. Bucket tables have a fixed size.

Defined cases: a null text has no words and fails the base rules; without labels both multinomials
are flat alike and the ratio is 0; repeated rows count as often as they occur.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefin.llm.native import let, literal_array
from sablefin.llm.shared import SPACE, table

BUCKETS, TRUSTED, THRESHOLD = 1 << 14, 20_000, -0.05
WINDOW = 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def features(h: Column) -> Column:
    """Buckets of all words and of all neighbouring pairs."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(h) - 1), lambda i: bucket(F.xxhash64(F.get(h, i - 1), F.get(h, i))))
    return F.when(F.size(h) > 1, F.concat(F.transform(h, bucket), pairs)).otherwise(F.transform(h, bucket))


def repeat_words(h: Column) -> Column:
    """Words in windows that occur twice or more, from word hashes.

    Window hashes are sorted first; only a text with two equal neighbours goes on to positions.
    """
    n = F.size(h)

    def covered(windows):
        pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))

        def positions(p):
            kept = F.filter(p, lambda x, j: F.coalesce(F.get(p, j - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(p, j + 1)["w"] == x["w"], F.lit(False)))
            return F.sort_array(F.transform(kept, lambda x: x["i"]))

        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            let(pairs, positions), zero,
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
            lambda acc: acc["n"],
        )

    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    repeats = lambda w: F.size(F.array_distinct(w)) < F.size(w)
    return F.when(n <= WINDOW, F.lit(0)).otherwise(let(windows, lambda w: F.when(repeats(w), covered(w)).otherwise(F.lit(0))))


def log_ratios(docs: DataFrame, labels: DataFrame, trusted: int = TRUSTED) -> list[float]:
    """log P(bucket | trusted) - log P(bucket | corpus), add-one smoothed."""
    verdict = labels.groupBy(F.col("doc_id").alias("trusted_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    ids = verdict.filter("good = 1 and coalesce(toxic, 0) = 0").select("trusted_id").orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(trusted)
    rows = docs.select("doc_id", hashed(words_of(F.coalesce(F.col("text"), F.lit("")))).alias("h"))
    marked = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("trusted_id"), "left")
    counts = (
        marked.select(F.explode(features(F.col("h"))).alias("b"), F.col("trusted_id").isNotNull().cast("int").alias("good"))
        .groupBy("b").agg(F.count("*").alias("n"), F.sum("good").alias("m"))
    )
    raw, good = [1.0] * BUCKETS, [1.0] * BUCKETS
    for r in counts.collect():  # at most BUCKETS rows
        raw[r["b"]] += r["n"]
        good[r["b"]] += r["m"]
    a, b = math.log(sum(good)), math.log(sum(raw))
    if sum(good) == BUCKETS:
        return [0.0] * BUCKETS
    return [round(math.log(g) - a - math.log(r) + b, 5) for g, r in zip(good, raw, strict=True)]


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    ratios = literal_array(log_ratios(docs, labels), "double")
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    words = text.select("doc_id", "t", words_of(F.col("t")).alias("w"))
    base = words.select("doc_id", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), hashed(F.col("w")).alias("h"), "t")
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = base.select(
        "doc_id", "n_words", "word_chars",
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("h")).cast("long").alias("n_repeat_words"),
        F.aggregate(features(F.col("h")), F.lit(0.0).cast("double"), lambda acc, b: acc + F.get(ratios, b)).alias("sum"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    score = F.round(F.col("sum") / F.greatest(F.lit(1), 2 * F.col("n_words") - 1), 6)
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (score >= threshold)).alias("kept"), score.alias("llr"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
