"""Language-model scores: prediction by partial matching over bytes, beside a unigram word base.

Contexts are the last ORDER bytes as they are, and each of their shorter ends. A symbol (a byte or the
end) is coded at the longest context it was seen in; a context escapes with probability distinct /
(total + distinct), and symbols seen in the longer context are excluded above (counts and distinct
symbols alike), down to a uniform share for symbols never seen. All of this depends only on context
and symbol, so the model is a table of cells (context, symbol). It grows with the input, is dealt by
context, and is never gathered: each level is joined with the one a byte shorter, where a row has at
most 256 partners.

Words for the base are counted in blocks of documents (by hash of id and text, about BLOCK_BYTES of text
each), so a word is shuffled once a block and not once a document, and each block gets back only the
counts of its own words. Cells go the same way: counted by block, and given back to the blocks that
have them, with their probability. A word's blocks are listed LISTED numbers at a time, so no list
grows with the corpus.

Defined cases: null texts are empty (one end token); a null doc_id is on the training side; without
training texts N and V are 0 and all symbols are uniform; repeated rows count as often as they occur.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sablefin.llm import kernels as K
from sablefin.llm.language import remainder
from sablefin.llm.shared import drop, materialise, table

SYMBOLS, END = 257, 256
ORDER, SYMBOL_BITS = 4, 9
BLOCK_BYTES, SLICE_BYTES = 6 << 20, 1 << 19
LISTED = 4096


def cells_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cell of each byte and each end, rows one after another; offsets of row r move by r.

    A cell is the context's bytes, the last one lowest, above SYMBOL_BITS of the symbol.
    """
    n = len(offsets) - 1
    total = len(data) + n
    ends = offsets[1:] + np.arange(n)
    symbol = np.empty(total, np.int64)
    is_end = np.zeros(total, bool)
    is_end[ends] = True
    symbol[~is_end] = data
    symbol[is_end] = END
    first = offsets[:-1] + np.arange(n)
    out = symbol.copy()
    for k in range(1, ORDER + 1):
        b = np.zeros(total, np.int64)
        b[k:] = symbol[:-k]
        for j in range(k):  # before a row's first byte there are zero bytes
            at = first + j
            b[at[at <= ends]] = 0
        out |= b << (SYMBOL_BITS + 8 * (k - 1))
    return out


def lowered(column) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = K.buffers(column)
    return K.byte_table()[data], offsets


def word_lists(data: np.ndarray, offsets: np.ndarray) -> pa.LargeListArray:
    text = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data)))
    return pc.ascii_split_whitespace(text)


def coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Rows and word codes of all words, and the words by code; the empty word is not one."""
    lists = word_lists(data, offsets)
    words = lists.flatten().dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    blank = pc.index(words.dictionary, pa.scalar("", words.dictionary.type)).as_py()
    keep = code != blank if blank >= 0 else slice(None)
    return row[keep], code[keep], words.dictionary.cast(pa.string())


def parts_of(block: pa.Table):
    """Slices of a block's texts: (first row, row after the last, lowered bytes, offsets)."""
    data, offsets = lowered(block.column("text").combine_chunks())
    for a, b in K.slices(offsets, SLICE_BYTES):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def summed(keys: list, counts: list, kind: pa.DataType) -> pa.Table:
    both = pa.table({"key": pa.concat_arrays([pa.array([], kind), *keys]), "n": pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))})
    return both.group_by("key").aggregate([("n", "sum")])


def block_counts(block: pa.Table) -> pa.Table:
    """For one block: each word and each cell with its training count; a held-out one is counted nowhere, but asked for."""
    train = ~np.asarray(block.column("held_out").combine_chunks().to_numpy(zero_copy_only=False), bool)
    words, word_n, cells, cell_n = [pa.array([""])], [np.array([train.sum()])], [], []
    for a, b, data, offsets in parts_of(block):
        row, code, names = coded(data, offsets)
        asked = np.bincount(code, minlength=len(names)) > 0
        words.append(names.filter(pa.array(asked)))
        word_n.append(np.bincount(code[train[a:b][row]], minlength=len(names))[asked])
        all_ = cells_of(data, offsets)
        live = np.repeat(train[a:b], np.diff(offsets) + 1)
        for part, weight in ((all_[live], 1), (all_[~live], 0)):
            found = pc.value_counts(pa.array(part))
            cells.append(found.field("values"))
            cell_n.append(found.field("counts").to_numpy() * weight)
    words, cells = summed(words, word_n, pa.string()), summed(cells, cell_n, pa.int64())
    number = block.column("block")[0].as_py() if block.num_rows else 0
    K.tidy()
    return pa.table({
        "block": pa.array(np.full(len(words) + len(cells), number)),
        "word": pa.concat_arrays([words["key"].combine_chunks(), pa.nulls(len(cells), pa.string())]),
        "cell": pa.concat_arrays([pa.nulls(len(words), pa.int64()), cells["key"].combine_chunks()]),
        "n": pa.concat_arrays([words["n_sum"].combine_chunks(), cells["n_sum"].combine_chunks()]),
    })


def cell_prices(cells: DataFrame) -> DataFrame:
    """(cell, price): log10 probability of each cell of (cell, n), n the training count."""
    levels = [materialise(cells.select("cell", "n"), "cells")]
    for k in range(ORDER - 1, -1, -1):
        shorter = F.col("cell").bitwiseAND(F.lit((1 << (SYMBOL_BITS + 8 * k)) - 1)).alias("cell")
        levels.append(materialise(levels[-1].groupBy(shorter).agg(F.sum("n").alias("n")), "cells"))
    levels.reverse()  # from the empty context down
    before = None
    # All symbols of a context are in one group, at most SYMBOLS rows.
    context = Window.partitionBy(F.shiftright("cell", SYMBOL_BITS))
    total, kinds = F.sum("n").over(context), F.count_if(F.col("n") > 0).over(context)
    free = F.greatest(F.lit(SYMBOLS) - F.col("kinds"), F.lit(1))
    known = levels[0].select("cell", "n", total.alias("total"), kinds.alias("kinds")).withColumn("rest", 1.0 / free)  # of symbols not seen in the context: given it escapes
    for k in range(1, ORDER + 1):
        known = materialise(known, "cell-levels")
        drop(before, levels[k - 1])
        before = known
        above = known.select(F.col("cell").alias("up"), F.col("n").alias("n_up"), F.col("total").alias("total_up"), F.col("kinds").alias("kinds_up"), F.col("rest").alias("rest_up"))
        shorter = F.col("cell").bitwiseAND(F.lit((1 << (SYMBOL_BITS + 8 * (k - 1))) - 1))
        both = levels[k].withColumn("up", shorter).join(above, "up")
        taken = F.sum(F.when(F.col("n") > 0, F.col("n_up")).otherwise(0)).over(context)
        both = both.select("*", total.alias("total"), kinds.alias("kinds"), taken.alias("taken"))
        over, new = F.col("total_up") - F.col("taken"), F.col("kinds_up") - F.col("kinds")
        escaping = F.when(F.col("kinds_up") < SYMBOLS, new).otherwise(0)
        bottom = F.greatest(over + escaping, F.lit(1))
        escape = F.when(new > 0, escaping / bottom).otherwise(1.0)
        rest = F.when(F.col("n_up") > 0, F.col("n_up") / bottom).otherwise(escape * F.col("rest_up"))
        known = both.select("cell", "n", "total", "kinds", rest.alias("rest"))
    escaping = F.when(F.col("kinds") < SYMBOLS, F.col("kinds")).otherwise(0)
    bottom = F.greatest(F.col("total") + escaping, F.lit(1))
    p = F.when(F.col("n") > 0, F.col("n") / bottom).otherwise(F.when(F.col("total") > 0, escaping / bottom).otherwise(1.0) * F.col("rest"))
    return known.select("cell", F.log10(F.greatest(p, F.lit(1e-300))).alias("price"))


def listed(counted: DataFrame, kind: str) -> DataFrame:
    """Each word or cell with its count in, and the numbers of, its blocks; a row stands for at most LISTED neighbouring block numbers."""
    rows = counted.filter(F.col(kind).isNotNull()).groupBy(kind, F.floor(F.col("block") / LISTED).alias("part"))
    return materialise(rows.agg(F.sum("n").alias("n"), F.collect_list("block").alias("blocks")).drop("part"), f"{kind}-blocks")


def score_documents(docs: DataFrame, folds_: int = 7, held: int = 2) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    keyed = rows.select(
        "doc_id", "text", (remainder(F.col("doc_id"), folds_) == held).alias("held_out"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"),
    )
    counted = materialise(keyed.groupBy("block").applyInArrow(block_counts, "block long, word string, cell long, n long"), "block-counts")
    words, cells = listed(counted, "word"), listed(counted, "cell")
    drop(counted)
    word_counts = materialise(words.groupBy("word").agg(F.sum("n").alias("c")), "word-counts")
    total = word_counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    floor = math.log10(max(1, total["n"] + total["v"] + 1))
    prices = materialise(cell_prices(cells.groupBy("cell").agg(F.sum("n").alias("n"))), "cell-prices")

    def score(block: pa.Table, known: pa.Table) -> pa.Table:
        priced, counts = known.filter(pc.is_valid(known.column("cell"))), known.filter(pc.is_valid(known.column("word")))
        cell, price = priced.column("cell").combine_chunks(), priced.column("price").to_numpy()
        have, count = counts.column("word").combine_chunks().cast(pa.string()), counts.column("c").to_numpy()
        n = block.num_rows
        end = pc.index(have, "").as_py()
        end_count = int(count[end]) if end >= 0 else 0
        number, seen = np.ones(n, np.int64), np.full(n, int(end_count > 0))
        base, whole = np.full(n, math.log10(end_count + 1)), np.zeros(n)
        for a, b, data, offsets in parts_of(block):
            row, code, names = coded(data, offsets)
            if len(code):
                c = count[pc.index_in(names.take(pa.array(np.unique(code))), value_set=have).to_numpy()]
                c = np.bincount(np.unique(code), weights=c, minlength=len(names))
                number[a:b] += np.bincount(row, minlength=b - a)
                seen[a:b] += np.bincount(row, weights=(c > 0)[code], minlength=b - a).astype(np.int64)
                base[a:b] += np.bincount(row, weights=np.log10(c + 1.0)[code], minlength=b - a)
            at = pc.index_in(pa.array(cells_of(data, offsets)), value_set=cell).to_numpy()
            whole[a:b] = np.add.reduceat(price[at], offsets[:-1] + np.arange(b - a))
        K.tidy()
        return pa.table({
            "doc_id": block.column("doc_id"), "held_out": block.column("held_out"), "n_tokens": pa.array(number), "n_known": pa.array(seen, pa.int64()),
            "train_tokens": pa.array(np.full(n, total["n"]), pa.int64()), "base_score": pa.array(base - number * floor), "score": pa.array(whole),
        })

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    back = words.join(word_counts, "word").select(F.explode("blocks").alias("block"), "word", "c", none("long", "cell"), none("double", "price"))
    back = back.unionAll(cells.join(prices, "cell").select(F.explode("blocks").alias("block"), none("string", "word"), none("long", "c"), "cell", "price"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return keyed.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, schema)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
