"""Benchmark decontamination by spaced-seed hashing.

Words are runs of ASCII letters, digits and all non-ASCII bytes, with A-Z in lower case. A mask keeps
WEIGHT of SPAN neighbouring words and ignores the rest, so a substitution under an ignored place
leaves the seed hash as it is. Seed hashes of the benchmark fill a bit table (size by their number,
up to 2**27 bits) that each task holds against all windows of its documents; what passes is joined
with the benchmark's hashes. Hits are reduced to document, item and diagonal, and the texts around
are compared there: the best stretch (match +1, other -2), or else all words side by side on the diagonal, must
be min_overlap words, or all words of a shorter item, and match in min_percent of them. Items of
four to 18 words have seeds for every choice of a quarter of their words being replaced.

Defined cases: null texts have no words; an item without words matches nothing; rows with a null id
take no part; repeated rows give one result for each (doc_id, item_id).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefin.llm import kernels as K
from sablefin.llm.shared import materialise, table

MASKS = ("110110011101", "101011110011", "111010100111", "110011101011")
SPAN = len(MASKS[0])
#: Masks with the least and most words of the items they are for; a seed's tag is its place here, so both sides have the same.
SHAPES = (
    ("1", 1, 1), ("11", 2, 2), ("111", 3, 3), ("11", 4, 5), ("111", 6, 8), ("1101", 8, 8), ("1011", 8, 8), ("11001", 8, 8), ("10011", 8, 8),
    ("10111", 9, None), ("111001", 9, None), *((m, SPAN, None) for m in MASKS),
)
MIN_OVERLAP, MIN_PERCENT = 13, 75
BUCKET = 32768


def plain(data: np.ndarray) -> np.ndarray:
    """Lower case, and a space for each ASCII character that is no letter or digit."""
    lut = K.byte_table()
    for b in range(128):
        if not chr(b).isalnum():
            lut[b] = 32
    return lut[data]


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    clean = plain(data)
    starts, ends, first = K.word_bounds(clean, offsets)
    return K.word_hashes(clean, starts, ends), first


def seeds(h: np.ndarray, first: np.ndarray, shapes: list[int]):
    """(number, positions, hashes) for each of these SHAPES."""
    room = np.repeat(first[1:], np.diff(first)) - np.arange(len(h))
    for number in shapes:
        mask = SHAPES[number][0]
        at = np.flatnonzero(room >= len(mask))
        s = np.full(len(at), np.uint64(len(mask) * 64 + number), np.uint64)
        for k in np.flatnonzero([c == "1" for c in mask]):
            s = s * K.BASE + h[at + k]
        yield number, at, K.mix(s)


def pieces(column: pa.Array):
    data, offsets = K.buffers(column)
    for a, b in K.slices(offsets):
        yield a, b, *hashed_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def item_seeds(items: DataFrame) -> DataFrame:
    """item_id, position, hash, and the number of the shape."""

    def run(batches):
        for batch in batches:
            ids = batch.column("item_id").to_numpy(zero_copy_only=False)
            for a, b, h, first in pieces(batch.column("text")):
                size = np.diff(first)
                row = np.repeat(np.arange(a, b), size)
                start = np.repeat(first[:-1], size)
                for number, at, s in seeds(h, first, list(range(len(SHAPES)))):
                    least, most = SHAPES[number][1:]
                    words = size[row[at] - a]
                    keep = (words >= least) & (words <= (most or words))
                    at, s = at[keep], s[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row[at]].astype(np.int64)), pa.array(at - start[at]), pa.array(s.view(np.int64)), pa.array(np.full(len(at), number))], ["item_id", "ipos", "hash", "shape"])

    return items.mapInArrow(run, "item_id long, ipos long, hash long, shape long")


def bit_table(found: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of the seed hashes; 16 to 32 bits a seed, never over 2**27 bits."""
    bits = min(27, max(15, (16 * found.count()).bit_length()))
    at = F.shiftrightunsigned("hash", 64 - bits) + 1
    packed = found.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in packed:  # at most 2**27 / 32768 rows of 4 KB
        out[(r["b"] - 1) * BUCKET // 8 :][: BUCKET // 8] = np.frombuffer(r["m"], np.uint8)[: BUCKET // 8]
    return out, bits


def hits(docs: DataFrame, table_bits: np.ndarray, bits: int, shapes: list[int]) -> DataFrame:
    """doc_id, position and hash of windows that may be seeds of an item."""
    held = docs.sparkSession.sparkContext.broadcast(table_bits)

    def run(batches):
        table_ = held.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b, h, first in pieces(batch.column("text")):
                size = np.diff(first)
                for _, at, s in seeds(h, first, shapes):
                    p = s >> np.uint64(64 - bits)
                    found = np.flatnonzero((table_[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1)
                    if len(found):
                        row = np.searchsorted(first, at[found], "right") - 1
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a + row].astype(np.int64)), pa.array(at[found] - first[row]), pa.array(s[found].view(np.int64))], ["doc_id", "pos", "hash"])

    return docs.mapInArrow(run, "doc_id long, pos long, hash long")


def best_stretch(same: np.ndarray) -> tuple[int, int]:
    """The stretch with the highest sum of +1 for a match and -2 for another, as (start, end)."""
    score = np.concatenate(([0], np.cumsum(np.where(same, 1, -2))))
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score[1:] - low[:-1])) + 1
    start = int(np.flatnonzero(score[:end] == low[end - 1])[-1])
    return start, end


def overlaps(docs: DataFrame, items: DataFrame, min_overlap: int = MIN_OVERLAP, min_percent: int = MIN_PERCENT) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, n_words, n_same (positions in words): the best overlap of each pair."""
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    known = materialise(item_seeds(items), "seeds")
    shapes = sorted(r["shape"] for r in known.select("shape").distinct().collect())  # at most len(SHAPES) values
    found = hits(docs, *bit_table(known), shapes)
    diagonal = (F.col("pos") - F.col("ipos")).alias("diagonal")
    places = materialise(found.join(known.select("item_id", "ipos", "hash"), "hash").select("doc_id", "item_id", diagonal).distinct(), "diagonals")
    ids = places.select("doc_id").distinct()
    texts = docs.join(ids, "doc_id", "left_semi")

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            left, right = batch.column("text"), batch.column("item")
            cut = {}
            for name, column in (("d", left), ("i", right)):
                coded = column.dictionary_encode()
                words = {}
                for a, b, h, first in pieces(coded.dictionary):
                    for r in range(a, b):
                        words[r] = h[first[r - a] : first[r - a + 1]]
                cut[name] = [words.get(c) for c in coded.indices.to_pylist()]
            for doc, item, shift, x, y in zip(batch.column("doc_id").to_pylist(), batch.column("item_id").to_pylist(), batch.column("diagonal").to_pylist(), cut["d"], cut["i"], strict=True):
                if x is None or y is None:
                    continue
                lo, hi = max(0, -shift), min(len(y), len(x) - shift)
                if hi <= lo:
                    continue
                same = x[lo + shift : hi + shift] == y[lo:hi]
                for a, b in (best_stretch(same), (0, hi - lo)):
                    n = int(same[a:b].sum())
                    if b - a >= min(min_overlap, len(y)) and 100 * n >= min_percent * (b - a):
                        out.append((doc, item, lo + shift + a, lo + a, b - a, n))
                        break
            names = ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_same"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(6)], names)

    both = places.join(texts, "doc_id").join(items.withColumnRenamed("text", "item"), "item_id").select("doc_id", "item_id", "diagonal", "text", "item")
    good = both.mapInArrow(run, "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_same long")
    best = F.max(F.struct("n_same", -F.col("n_words"), -F.col("doc_start"), -F.col("item_start"))).alias("x")
    return good.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("x.col3")).alias("doc_start"), (-F.col("x.col4")).alias("item_start"), (-F.col("x.col2")).alias("n_words"), F.col("x.n_same").alias("n_same"),
    )


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without an overlap; rows with a null id stay."""
    found = materialise(overlaps(docs, items).select(F.col("doc_id").alias("leak_id")).distinct(), "leaks")
    return docs.join(found, docs["doc_id"] == found["leak_id"], "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
