"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into segments of SPAN bytes (A-Z in lower case); both directions run over each
segment from a zero state, so many segments advance together. Every position gets a softmax
over the languages, and a document's probabilities are the mean over all its positions. Gates use
softsign forms. Training is backpropagation through time in numpy with Adam over STEPS bytes, on at most
about PER_LANGUAGE labelled documents a language (chosen by hash) and WINDOWS stretches of each, at places
chosen by hash over the whole text; this sample is the only one. Prediction reads whole texts.

Defined cases: null texts and texts without a letter are "und" with score 0; without training rows
everything is; a null doc_id counts as training side; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefin.llm import kernels as K
from sablefin.llm.shared import table

STEPS, SPAN, HIDDEN, WIDTH = 64, 512, 8, 2048
PER_LANGUAGE, WINDOWS, WINDOW_CHARS = 400, 3, 160
ROUNDS, BATCH, RATE = 250, 192, 0.02


def remainder(doc_id: Column, by: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by)), F.lit(0))


def half(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * x / (1 + np.abs(x))


def soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=0, keepdims=True))
    return e / e.sum(axis=0, keepdims=True)


class Network:
    """Weights by name: for directions f and b an input table w (256 x 3H), u (3H x H), bias c of the candidate; output o, p."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden, self.classes = hidden, classes
        self.weights: dict[str, np.ndarray] = {"o": rng.normal(0, 0.3, (classes, 2 * hidden)), "p": np.zeros((classes, 1))}
        for d in "fb":
            self.weights |= {f"w{d}": rng.normal(0, 0.3, (256, 3 * hidden)), f"u{d}": rng.normal(0, 0.3, (3 * hidden, hidden)), f"c{d}": np.zeros((hidden, 1))}
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def step(self, d: str, x: np.ndarray, h: np.ndarray) -> tuple:
        """One position of one direction for columns of h: r, z, the recurrent part of the candidate, n, new h."""
        n = self.hidden
        a, b = self.weights[f"w{d}"][x].T, self.weights[f"u{d}"] @ h
        gates = half(a[: 2 * n] + b[: 2 * n])
        r, z = gates[:n], gates[n:]
        inner = b[2 * n :] + self.weights[f"c{d}"]
        new = soft(a[2 * n :] + r * inner)
        return r, z, inner, new, new + z * (h - new)

    def train(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> None:
        """x: bytes (steps x rows), lengths by row, y: class by row."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for t in range(1, rounds + 1):
            pick = rng.integers(0, x.shape[1], batch)
            grads = self.gradients(x[:, pick], lengths[pick], y[pick])
            now = rate * (1 - 0.9 * t / rounds)
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.weights[k] -= now * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        steps, n = x.shape
        hid, w = self.hidden, self.weights
        live = (np.arange(steps)[:, None] < lengths[None, :]).astype(np.float32)
        kept: dict[str, list] = {}
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            h, kept[d] = np.zeros((hid, n), np.float32), [None] * steps
            for t in order:
                r, z, inner, new, out = self.step(d, x[t], h)
                out = out * live[t]
                kept[d][t] = (h, r, z, inner, new, out)
                h = out
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        back = {d: [None] * steps for d in "fb"}
        total = live.sum()
        for t in range(steps):
            both = np.concatenate((kept["f"][t][5], kept["b"][t][5]))
            p = softmax(w["o"] @ both + w["p"])
            p[y, np.arange(n)] -= 1
            p *= live[t] / total
            grads["o"] += p @ both.T
            grads["p"] += p.sum(axis=1, keepdims=True)
            g = w["o"].T @ p
            back["f"][t], back["b"][t] = g[:hid], g[hid:]
        for d, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
            carry = np.zeros((hid, n), np.float32)
            for t in order:
                h, r, z, inner, new, _ = kept[d][t]
                g = (back[d][t] + carry) * live[t]
                dn = g * (1 - z) * (1 - np.abs(new)) ** 2
                dz = g * (h - new) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                dr = dn * inner * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                di = dn * r
                rec = np.concatenate((dr, dz, di))
                carry = g * z + w[f"u{d}"].T @ rec
                grads[f"u{d}"] += rec @ h.T
                grads[f"c{d}"] += di.sum(axis=1, keepdims=True)
                np.add.at(grads[f"w{d}"], x[t], np.concatenate((dr, dz, dn)).T)
        return grads

    def segments(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Summed probabilities (classes x columns) over the positions of each column; lengths must not increase."""
        steps, n = x.shape
        hid, w = self.hidden, self.weights
        live = np.searchsorted(-lengths, -np.arange(1, steps + 1), "right")
        out_f, out_b = w["o"][:, :hid], w["o"][:, hid:]
        seen = np.zeros((steps, self.classes, n), np.float32)
        h = np.zeros((hid, n), np.float32)
        for t in range(steps):
            m = live[t]
            if not m:
                break
            h = self.step("f", x[t, :m], h[:, :m])[4]
            seen[t, :, :m] = out_f @ h
        total = np.zeros((self.classes, n), np.float32)
        h = np.zeros((hid, n), np.float32)
        for t in range(steps - 1, -1, -1):
            m = live[t]
            if not m:
                continue
            h[:, :m] = self.step("b", x[t, :m], h[:, :m])[4]
            total[:, :m] += softmax(seen[t, :, :m] + out_b @ h[:, :m] + w["p"])
        return total

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities (rows x classes) over all positions of each row; zero for empty rows."""
        sizes = np.diff(offsets)
        count = -(-sizes // SPAN)
        row = np.repeat(np.arange(len(sizes)), count)
        number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = offsets[row] + number * SPAN
        length = np.minimum(SPAN, offsets[row + 1] - start)
        order = np.argsort(-length, kind="stable")
        data = np.concatenate((data, np.zeros(SPAN, np.uint8)))
        out = np.zeros((len(sizes), self.classes))
        for a in range(0, len(order), WIDTH):
            part = order[a : a + WIDTH]
            total = self.segments(data[start[part][None, :] + np.arange(SPAN)[:, None]], length[part])
            for c in range(self.classes):
                out[:, c] += np.bincount(row[part], weights=total[c], minlength=len(sizes))
        return out / np.maximum(sizes, 1)[:, None]


def training_rows(docs: DataFrame) -> list[tuple[str, str]]:
    """(lang, stretch of text) of a bounded sample of labelled documents on the training side."""
    able = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), 4) != 2)).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in able.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 20, -(-PER_LANGUAGE * (1 << 20) // n)))).otherwise(share)
    some = able.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
    at = lambda i: 1 + F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(F.lit(1), F.length("text") - WINDOW_CHARS)).cast("int")
    cut = [F.substring(F.col("text"), at(i), F.lit(WINDOW_CHARS)) for i in range(WINDOWS)]
    rows = some.select("lang", F.xxhash64("doc_id").alias("h"), F.array_distinct(F.array(*cut)).alias("x"))
    rows = rows.orderBy("h", "lang", "x").limit(2 * PER_LANGUAGE * len(sizes))  # twice the share asked for, reached only by many rows of one id
    return sorted((r["lang"], x) for r in rows.collect() for x in r["x"])


def fit(rows: list[tuple[str, str]]) -> tuple[list[str], Network | None]:
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return [], None
    rng = np.random.default_rng(5)
    lut, xs, ys, lengths = K.byte_table(), [], [], []
    for lang, text in rows:
        data = lut[np.frombuffer(text.encode(), np.uint8)]
        for at in range(0, max(1, len(data)), STEPS):
            piece = data[at : at + int(rng.integers(STEPS // 4, STEPS + 1))]
            if len(piece):
                xs.append(np.pad(piece, (0, STEPS - len(piece))))
                ys.append(langs.index(lang))
                lengths.append(len(piece))
    # The same number of rows for each language.
    y = np.array(ys)
    most = max(np.bincount(y))
    pick = np.concatenate([np.resize(np.flatnonzero(y == c), most) for c in range(len(langs))])
    net = Network(len(langs))
    net.train(np.stack(xs)[pick].T.copy(), np.array(lengths)[pick], y[pick])
    return langs, net


def judge(text: pa.Array, langs: list[str], net: Network | None) -> tuple[np.ndarray, np.ndarray]:
    """Languages and scores of a column of whole texts."""
    n = len(text)
    best, score = np.zeros(n, np.int64), np.zeros(n)
    if net is not None:
        lut = K.byte_table()
        data, offsets = K.buffers(text)
        for a, b in K.slices(offsets, 4 << 20):
            p = net.documents(lut[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a])
            best[a:b], score[a:b] = p.argmax(axis=1), p.max(axis=1)
    letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    found = letters & (net is not None)
    names = np.array([*langs, "und"], dtype=object)[np.where(found, best, len(langs))]
    return names, np.where(found, np.clip(score, 0, 1), 0.0)


def identify(docs: DataFrame, langs: list[str], net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of each row."""

    def run(batches):
        for batch in batches:
            names, score = judge(batch.column("text"), langs, net)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, langs: list[str], net: Network | None, min_gain: float) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language with a score of at least this share of the way from chance to 1."""
    chance = 1 / max(1, len(langs))
    least = chance + min_gain * (1 - chance)

    def run(batches):
        for batch in batches:
            names, score = judge(batch.column("text"), langs, net)
            yield batch.filter(pa.array((names != "und") & (score >= least)))
        K.tidy()

    return docs.mapInArrow(run, docs.schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, *fit(training_rows(docs)))
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
