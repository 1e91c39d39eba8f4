"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A sketch of SIZE coordinates is filled in rounds: in round i < SIZE each shingle hashes to one bin
and a value, in round SIZE + j all hash to bin j; the smallest value of the earliest round stays.
Every coordinate is filled, and a long set needs only a round or two. Bands of ROWS coordinates are
bucket keys; at similarity s a pair shares one of BANDS keys but for (1 - s**ROWS)**BANDS, which is
4e-7 at 0.85.

Documents with equal sets form one class (by size and a 128-bit digest of the set). First comes a star,
one pair a class: each bucket has a centre (the class with the fullest buckets, which is what the others
were copied from), and full sets decide.

Classes in buckets that still hold several components go on to an exact join of their differences. All
that are joined by buckets form a region, whose centre is the set of shingles held by more than half of
it; a class is written as its difference D from that centre. With t = percent/100, n shingles and the
surplus q = |D| - n*(1-t)/(1+t), two classes are linked if, and only if, 2*|D1 & D2| >= q1 + q2. So a class
with q1 + q2 <= 0 against the region's smallest q is linked to that one, and all other pairs must share a
shingle of their differences, within the first of each by rarity (prefix filter; classes of q tell how
many) and with enough left behind it (positional filter). In a group of near copies of one text the
differences are small and mostly their own, so no group's pairs are listed or compared.

Defined cases: a text without words (or null) has an empty set and is linked with nothing; one or
two words are one shingle; a row with a null doc_id takes no part, its component_id is null and it is
kept; repeated rows of one doc_id share their component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sablefin.llm import kernels as K
from sablefin.llm.components import components
from sablefin.llm.native import probably_in
from sablefin.llm.shared import drop, materialise, table

BANDS, ROWS = 25, 5
SIZE = BANDS * ROWS
ROW_BITS = 10
SLACK = 0.16


def shingle_keys(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted by row: row numbers and 54-bit hashes."""
    n = len(offsets) - 1
    starts, ends, first = K.word_bounds(data, offsets)
    h = K.word_hashes(data, starts, ends)
    count = np.diff(first)
    take = np.minimum(count, words)
    wide = np.maximum(count - words + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(n), wide)
    at = np.repeat(first[:-1], wide) + (np.arange(len(row)) - np.repeat(np.cumsum(wide) - wide, wide))
    s = np.zeros(len(row), np.uint64)
    for k in range(words):
        inside = take[row] > k
        if inside.all():
            s = K.mix(s + h[at + k] + np.uint64(k + 1))
        else:
            s[inside] = K.mix(s[inside] + h[at[inside] + k] + np.uint64(k + 1))
    shift = np.uint64(64 - ROW_BITS)
    keys = np.sort((row.astype(np.uint64) << shift) | (s >> np.uint64(ROW_BITS)))
    if len(keys):
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    return (keys >> shift).astype(np.int64), keys & np.uint64((1 << (64 - ROW_BITS)) - 1)


def sketches(row: np.ndarray, h: np.ndarray, n: int, size: int) -> np.ndarray:
    """Fast similarity sketches of n rows; empty rows stay at the highest value."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * size, empty, np.uint64)
    open_row = np.zeros(n, bool)
    open_row[np.unique(row)] = True
    for i in range(2 * size):
        v = K.mix(h + np.uint64(0xD1B54A32D192ED03 * (i + 1) % (1 << 64)))
        if i < size:
            bins = ((v >> np.uint64(40)) * np.uint64(size)) >> np.uint64(24)
            at = row * size + bins.astype(np.int64)
        else:
            at = row * size + (i - size)
        # The round in the top bits: an earlier round's value always stays.
        np.minimum.at(out, at, (np.uint64(i) << np.uint64(55)) | (K.mix(v) >> np.uint64(9)))
        open_row &= (out.reshape(n, size) == empty).any(axis=1)
        if not open_row.any():
            break
        if i % 4 == 0 or i < 3:
            keep = open_row[row]
            row, h = row[keep], h[keep]
    return out.reshape(n, size)


def chunks(column: pa.Array):
    """Slices of a text column that the kernels take at once: (first row, bytes, offsets)."""
    data, offsets = K.buffers(column)
    for a, b in K.slices(offsets):
        for c in range(a, b, 1 << ROW_BITS):
            d = min(b, c + (1 << ROW_BITS))
            yield c, K.byte_table()[data[offsets[c] : offsets[d]]], offsets[c : d + 1] - offsets[c]


def sketch_table(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys, and 16 bits of each coordinate."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for at, data, offsets in chunks(batch.column("text")):
                n = len(offsets) - 1
                row, h = shingle_keys(data, offsets, words)
                count = np.bincount(row, minlength=n)
                d1, d2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                some = np.flatnonzero(count)
                if len(some):
                    first = (np.cumsum(count) - count)[some]
                    d1[some] = np.add.reduceat(K.mix(h + np.uint64(1)), first)
                    d2[some] = np.add.reduceat(K.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
                sk = sketches(row, h, n, SIZE)
                keys = np.zeros((n, BANDS), np.uint64)
                for r in range(ROWS):
                    keys = K.mix(keys + sk[:, r::ROWS] + np.uint64(r + 1))
                keys = K.mix(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                part = (K.mix(sk) >> np.uint64(48)).astype(np.uint16)
                lists = lambda x, t: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel(), t))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, n), pa.array(count, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists(keys, pa.int64()), lists(part.view(np.int16), pa.int16())],
                    ["doc_id", "n_shingles", "d1", "d2", "keys", "sketch"],
                )
        K.tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, sketch array<short>")


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets satisfy 100 * intersection >= percent * union; pairs is a written table."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            left, right = K.buffers(batch.column("ta")), K.buffers(batch.column("tb"))
            total = left[1] + right[1]
            linked = np.zeros(batch.num_rows, bool)
            for x, y in K.slices(total):
                for c in range(x, y, 1 << ROW_BITS):
                    d = min(y, c + (1 << ROW_BITS))
                    n, sets = d - c, []
                    for data, offsets in (left, right):
                        row, h = shingle_keys(K.byte_table()[data[offsets[c] : offsets[d]]], offsets[c : d + 1] - offsets[c], words)
                        sets.append((row.astype(np.uint64) << np.uint64(64 - ROW_BITS)) | h)
                    both = np.sort(np.concatenate(sets))
                    same = both[1:][both[1:] == both[:-1]] >> np.uint64(64 - ROW_BITS)
                    inter = np.bincount(same.astype(np.int64), minlength=n)
                    union = np.bincount((both >> np.uint64(64 - ROW_BITS)).astype(np.int64), minlength=n) - inter
                    linked[c:d] = (union > 0) & (100 * inter >= percent * union)
            mask = pa.array(linked)
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])
        K.tidy()

    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    ids = materialise(ids, "text-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(probably_in(ids)(F.col("doc_id")))
    texts = materialise(texts.join(ids, "doc_id", "left_semi"), "texts")
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    out = materialise(pairs.select("a", "b").join(a, "a").join(b, "b").mapInArrow(run, "a long, b long"), "verified")
    drop(texts, ids)
    return out


def agreement(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda acc, v: acc + v) / F.lit(SIZE)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    rows = materialise(sketch_table(docs, words), "sketches")
    full = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = materialise(full.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("class")), "classes")
    keyed = full.drop("sketch").join(classes.select(F.col("class").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id", "n_shingles", "d1", "d2"])
    buckets = keyed.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    shared = materialise(buckets.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    held = materialise(buckets.join(shared, "key"), "held")
    weight = materialise(held.groupBy("id").agg(F.sum("size").alias("weight")), "weights")
    sketch = rows.select(F.col("doc_id").alias("id"), "sketch").filter(probably_in(weight.select("id"))(F.col("id"))).join(weight.select("id"), "id", "left_semi").dropDuplicates(["id"])
    sketch = materialise(sketch, "own-sketches")
    rest = materialise(held.join(weight, "id").withColumn("label", F.col("id")), "rest")
    drop(shared)
    # What a sketch leaves out here is not lost: the join of differences looks at all pairs of different components.
    more = materialise(agreeing(star_pairs(rest, percent), sketch, percent / 100 - SLACK), "pairs")
    links = verified(more, docs, words, percent)
    labels = components(links)
    drop(more, rest)
    rest = mixed_buckets(held.join(weight, "id"), labels)
    if not rest.isEmpty():
        drop(labels)
        labels = components(links.union(difference_links(rest, docs, words, percent)))
    drop(rest, held, sketch, weight)
    named = classes.join(labels, F.col("class") == F.col("v"), "left").select("n_shingles", "d1", "d2", F.coalesce("label", "class").alias("component_id"))
    named = materialise(named, "named")
    drop(classes, labels)
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", "d1", "d2").join(named, ["n_shingles", "d1", "d2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"),
    )


def fits(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes may reach the similarity at all."""
    return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)


def star_pairs(rest: DataFrame, percent: int) -> DataFrame:
    """For each class one pair (a, b) at most: with the centre of that of its buckets whose centre is the weightiest."""
    tops = rest.groupBy("key").agg(F.min_by(F.struct("id", "n", "weight", "label"), F.struct(-F.col("weight"), "id")).alias("top"))
    near = rest.join(tops, "key").filter((F.col("label") != F.col("top.label")) & fits(F.col("n"), F.col("top.n"), percent))
    return near.groupBy(F.col("id").alias("a")).agg(F.max(F.struct("top.weight", -F.col("top.id"))).alias("x")).select("a", (-F.col("x.col2")).alias("b"))


def agreeing(pairs: DataFrame, sketch: DataFrame, least: float) -> DataFrame:
    x = sketch.select(F.col("id").alias("a"), F.col("sketch").alias("sa"))
    y = sketch.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))
    return pairs.join(x, "a").join(y, "b").filter(agreement(F.col("sa"), F.col("sb")) >= least).select("a", "b")


def mixed_buckets(held: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of held, with labels, of the buckets that hold several components."""
    marked = materialise(held.join(labels, F.col("id") == F.col("v"), "left").select("id", "n", "key", "weight", F.coalesce("label", "id").alias("label")), "marked")
    mixed = marked.groupBy("key").agg((F.min("label") != F.max("label")).alias("mixed")).filter("mixed").select("key")
    rest = materialise(marked.join(mixed, "key", "left_semi"), "rest")
    drop(marked)
    return rest


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """Rows of docs (doc_id, text, region, label) with the set of shingle hashes in place of the text."""

    def run(batches):
        for batch in batches:
            for at, data, offsets in chunks(batch.column("text")):
                n = len(offsets) - 1
                row, h = shingle_keys(data, offsets, words)
                ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32)
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "region", "label")), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.astype(np.int64)))], ["id", "region", "label", "set"])
        K.tidy()

    return docs.mapInArrow(run, "id long, region long, label long, set array<long>")


def difference_links(rest: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that join all components of the rows of rest that any pair of them in one region joins.

    A doc_id that stands for several texts has one set for each. Surpluses are in units of 1/(100 + percent).
    """
    one = 100 + percent
    starts = rest.groupBy("key").agg(F.min("id").alias("b"))
    regions = components(rest.join(starts, "key").select(F.col("id").alias("a"), "b").distinct())
    named = regions.select("v", F.col("label").alias("region"))
    members = materialise(rest.select("id", "label").distinct().join(named, F.col("id") == F.col("v")).select("id", "label", "region"), "members")
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(probably_in(members.select("id"))(F.col("doc_id"))).join(members, F.col("doc_id") == F.col("id")).select("doc_id", "text", "region", "label")
    sets = materialise(shingle_sets(some.dropDuplicates(["doc_id", "text"]), words), "sets")
    size = sets.groupBy("region").agg(F.count("*").alias("members"))
    common = sets.select("region", F.explode("set").alias("h")).groupBy("region", "h").agg(F.count("*").alias("f"))
    centre = common.join(size, "region").filter(2 * F.col("f") > F.col("members")).groupBy("region").agg(F.collect_list("h").alias("centre"))
    centre = materialise(centre, "centres")  # at most twice the mean set of its region
    apart = F.concat(F.array_except("set", "centre"), F.array_except("centre", "set"))
    surplus = F.size("apart").cast("long") * one - F.size("set") * (100 - percent)
    diffs = sets.join(centre, "region", "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<long>")))
    diffs = diffs.withColumn("apart", apart).select("id", F.xxhash64("set").alias("which"), "region", "label", F.size("set").alias("n"), "apart", surplus.alias("q"))
    diffs = materialise(diffs, "differences")
    drop(sets, centre, members, regions)

    ends = materialise(diffs.groupBy("region").agg(F.min(F.struct("q", "id", "label")).alias("best"), F.max("q").alias("most")), "region-ends")
    near = diffs.join(ends, "region").filter((F.col("q") + F.col("best.q") <= 0) & (F.col("label") != F.col("best.label")))
    links = near.select(F.col("id").alias("a"), F.col("best.id").alias("b"))

    class_ = lambda q: F.when(q <= 0, 0).otherwise(1 + F.floor(F.log2(F.greatest(q / F.lit(one), F.lit(1.0))))).cast("int")
    each = diffs.select("id", "which", "region", "label", "n", "q", F.explode("apart").alias("h"))
    twice = each.groupBy("region", "h").agg(F.count("*").alias("f")).filter("f > 1")
    behind = F.row_number().over(Window.partitionBy("id", "which").orderBy(F.desc("f"), F.desc("h")))
    held = each.join(twice, ["region", "h"]).withColumn("behind", behind)  # shingles of the difference from this one on, rarest first
    held = held.join(ends.select("region", F.col("best.q").alias("least"), "most"), "region")
    room = 2 * one * F.col("behind") - F.col("q")  # the largest surplus of a partner that this shingle may be the first to share with
    classes = F.sequence(F.when(F.col("least") <= 0, 0).otherwise(1), F.least(class_(room), class_(F.col("most"))))
    mine = held.filter(room >= F.col("least")).withColumn("mine", class_(F.col("q")))
    mine = mine.select("*", F.explode(F.when(F.size(classes) > 0, classes)).alias("theirs"))
    mine = materialise(mine.select("id", "which", "region", "label", "n", "q", "h", "behind", "mine", F.least("mine", "theirs").alias("low"), F.greatest("mine", "theirs").alias("high")), "prefixes")
    x = mine.select("region", "h", "low", "high", *[F.col(c).alias(f"{c}_a") for c in ("id", "which", "label", "n", "q", "behind", "mine")])
    y = mine.select("region", "h", "low", "high", *[F.col(c).alias(f"{c}_b") for c in ("id", "which", "label", "n", "q", "behind", "mine")])
    both = F.col("q_a") + F.col("q_b")
    test = (
        (F.col("id_a") < F.col("id_b")) & (F.col("label_a") != F.col("label_b")) & (F.col("mine_a") + F.col("mine_b") == F.col("low") + F.col("high"))
        & fits(F.col("n_a"), F.col("n_b"), percent) & (both > 0) & (2 * one * F.least("behind_a", "behind_b") >= both)
    )
    ids = ["id_a", "which_a", "id_b", "which_b"]
    pairs = materialise(x.join(y, ["region", "h", "low", "high"]).filter(test).select(*ids).distinct(), "pairs")
    whole = diffs.select("id", "which", "q", "apart")
    for side in "ab":
        pairs = pairs.join(whole.select(*[F.col(c).alias(f"{c}_{side}") for c in whole.columns]), [f"id_{side}", f"which_{side}"])
    confirmed = pairs.filter(2 * one * F.size(F.array_intersect("apart_a", "apart_b")) >= both)
    links = materialise(links.union(confirmed.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))), "links")
    drop(diffs, ends, mine)
    return links


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
