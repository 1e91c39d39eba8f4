"""Harmonic packing of documents into fixed-capacity token sequences.

Class j (1 to CLASSES) takes documents of more than capacity / (j + 1) and at most capacity / j tokens, the
last class all smaller ones too, and a bin of class j takes exactly j of them, whole. So filling needs no
search and each worker packs alone. A full bin's gap is closed by the next document, the only one that is
cut for it; what is left of that one goes to its own class. Longer documents give whole sequences first.
When a worker ends, its open bins are poured together in order and cut at the ends of sequences, and the
final partial sequence is split at powers of two, which need no padding. Memory holds at most one open bin a
class and one that waits for its gap to be closed.

Defined cases: a null text is an empty document (only its end id); the order of rows within a
partition decides neighbours; a null doc_id is carried as null; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefin.llm.kernels import slices, tidy
from sablefin.llm.shared import table

CAPACITY, CLASSES, END_ID = 4096, 32, 2
CACHE_WORDS, BATCH_BYTES = 300_000, 4 << 20
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
SCHEMA = ", ".join(f"{c} long" for c in COLUMNS)


class Encoder:
    """Ids of texts. White space ends every pre-token of this vocabulary, so each word is looked up after it is seen once.

    A word of Latin letters and then ASCII marks (no apostrophe) is two pre-tokens, the first in lower
    case; these pieces are shared between words and go straight to the merge model, as bytes written in
    the vocabulary's alphabet. Other words go through the whole tokenizer as they stand.
    """

    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.alphabet = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in plain)}
        self.clear()

    @staticmethod
    def shared(path: str) -> Encoder:
        """One encoder for each worker process and vocabulary, kept over its tasks."""
        held = sys.modules.setdefault("_sablefin_encoders", types.ModuleType("_sablefin_encoders")).__dict__
        if path not in held:
            held[path] = Encoder(path)
        return held[path]

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.pieces: dict[str, int] = {"": 0}
        self.flat, self.offsets = np.zeros(0, np.uint32), np.zeros(2, np.int64)
        self.parts = np.zeros((0, 2), np.int64)

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of plain pieces."""
        merge = self.tokenizer.model.tokenize
        return [[t.id for t in merge(p.encode().decode("latin-1").translate(self.alphabet))] for p in pieces]

    def learn(self, words: list[str]) -> None:
        at, n = self.pieces, len(self.index)
        plain = [m.groups() if (m := self.PLAIN.fullmatch(w)) else None for w in words]
        split = [(m[0].lower(), m[1]) if m else (w, "") for w, m in zip(words, plain, strict=True)]
        new = list({p for pair, m in zip(split, plain, strict=True) if m for p in pair}.difference(at))
        other = list({w for w, m in zip(words, plain, strict=True) if not m}.difference(at, new))
        ids = self.encode(new) + [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        at.update(zip([*new, *other], range(len(at), len(at) + len(ids)), strict=True))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))))
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(sizes)))
        self.index.update(zip(words, range(n, n + len(words)), strict=True))
        pairs = np.fromiter((at[p] for pair in split for p in pair), np.int64, 2 * len(split))
        self.parts = np.concatenate((self.parts, pairs.reshape(-1, 2)))

    def batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.index) > CACHE_WORDS:
            self.clear()
        fresh = [w for w in words if w not in self.index]
        if fresh:
            self.learn(fresh)
        parts = self.parts[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))]
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            at = parts[code[a:b]].ravel()
            first = self.offsets[at]
            sizes = self.offsets[at + 1] - first
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            out = np.empty(total + 1, np.uint32)
            out[:total] = self.flat[np.repeat(first - (ends - sizes), sizes) + np.arange(total)]
            out[total] = END_ID
            yield out


class Packer:
    """One worker's bins. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, first: int, capacity: int = CAPACITY, classes: int = CLASSES):
        self.next, self.capacity = first, capacity
        self.bins: list[list] = [[] for _ in range(classes + 1)]
        self.waiting: list = []
        self.gap = 0
        self.tail: list = []
        self.tail_room = capacity
        self.rows: list[tuple] = []

    def emit(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def pour(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids):
            part = ids[: self.tail_room]
            self.tail.append((doc, start, part, total))
            self.tail_room -= len(part)
            start, ids = start + len(part), ids[len(part) :]
            if not self.tail_room:
                self.emit(self.tail)
                self.tail, self.tail_room = [], self.capacity

    def add(self, doc, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        while start < total:
            rest = ids[start:]
            if self.waiting:
                part = rest[: self.gap]
                self.waiting.append((doc, start, part, total))
                start, self.gap = start + len(part), self.gap - len(part)
                if not self.gap:
                    self.emit(self.waiting)
                    self.waiting = []
            elif len(rest) >= self.capacity:
                self.emit([(doc, start, rest[: self.capacity], total)])
                start += self.capacity
            else:
                number = min(self.capacity // len(rest), len(self.bins) - 1)
                held = self.bins[number]
                held.append((doc, start, rest.copy() if start else rest, total))
                start = total
                if len(held) == number:
                    self.bins[number], self.gap = [], self.capacity - sum(len(p[2]) for p in held)
                    if self.gap:
                        self.waiting = held
                    else:
                        self.emit(held)

    def close(self) -> None:
        for held in (self.waiting, *self.bins):
            for piece in held:
                self.pour(*piece)
        self.waiting, self.bins = [], [[] for _ in self.bins]
        left, self.tail = self.tail, []
        room = 0
        now: list = []
        rest = sum(len(p[2]) for p in left)
        for doc, start, ids, total in left:
            while len(ids):
                if not room:
                    room = 1 << (rest.bit_length() - 1)
                part = ids[:room]
                now.append((doc, start, part, total))
                start, ids, room, rest = start + len(part), ids[len(part) :], room - len(part), rest - len(part)
                if not room:
                    self.emit(now)
                    now = []


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """Pieces of all documents in columns doc_id and text; no shuffle."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")

    def run(batches):
        encoder = Encoder.shared(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 33, capacity, classes)

        def flush():
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COLUMNS))], list(COLUMNS))

        for whole in batches:
            column = pc.fill_null(whole.column("text"), "").cast(pa.large_string())
            bounds = np.concatenate(([0], np.cumsum(pc.binary_length(column).to_numpy())))
            for a, b in slices(bounds, BATCH_BYTES):
                for doc, ids in zip(whole.column("doc_id").slice(a, b - a).to_pylist(), encoder.batch(column.slice(a, b - a)), strict=True):
                    packer.add(doc, ids)
                if packer.rows:
                    yield flush()
        packer.close()
        if packer.rows:
            yield flush()
        tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
