"""Places where an operator once did less than the whole job."""

from collections import Counter, defaultdict
from itertools import combinations

import pytest

import brute
from sablefin.llm import decontaminate, lines, ppm, quality


def ppm_scores(rows, order=ppm.ORDER):
    """{doc_id: log10 probability} by whole byte contexts, symbols of longer contexts excluded above."""
    lower = lambda t: (t or "").translate(brute.LOWER).encode()
    coded = lambda t: [(bytes(order) + lower(t), i + order, s) for i, s in enumerate([*lower(t), 256])]
    seen = defaultdict(Counter)
    for d, t in rows:
        if brute.crc(d) % 7 != 2:
            for x, i, s in coded(t):
                for k in range(order + 1):
                    seen[x[i - k : i]][s] += 1

    def price(x, i, s):
        p, out = 1.0, set()
        for k in range(order, -1, -1):
            full = seen[x[i - k : i]]
            here = {a: n for a, n in full.items() if a not in out}
            bottom = sum(here.values()) + (len(here) if len(full) < 257 else 0)
            if s in here:
                return p * here[s] / bottom
            p *= len(here) / bottom if here else 1.0
            out |= set(full)
        return p / (257 - len(out))

    import math

    return {d: math.fsum(math.log10(price(*c)) for c in coded(t)) for d, t in rows}


def test_lm_whole_contexts(spark):
    """Digits, accents and other scripts predict by their own bytes, four and five back."""
    texts = ["id 10421 ok id 20957 no", "été ère être", "привет мир", "日本語 日本", "<a>;b;{c}", "", None, "x", "The the THE cat"]
    rows = [(i, texts[i % len(texts)] if i % 5 else f"{texts[i % len(texts)]} {i * 7919}") for i in range(60)]
    got = {r["doc_id"]: r["score"] for r in ppm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = ppm_scores(rows)
    assert set(got) == set(want) and all(got[d] == pytest.approx(w, rel=1e-9, abs=1e-9) for d, w in want.items())


def pairs(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs, items).select("doc_id", "item_id").collect()}


def test_short_items_in_slices(spark):
    """Exact copies of short items are found however the benchmark is split."""
    texts = [" ".join(f"s{n}w{i}" for i in range(n)) for n in range(1, 13)]
    docs = [(n, f"before all {t} after all") for n, t in enumerate(texts)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").repartitionByRange(12, "item_id")
    assert pairs(spark, docs, items) == {(n, n) for n in range(12)}


def test_altered_short_items(spark):
    """A quarter of the words of an item may be replaced, whichever they are."""
    items, docs, want = [], [], set()
    for n in range(4, 17):
        words = [f"n{n}w{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        for m in range(n // 4 + 1):
            for gone in combinations(range(n), m):
                want.add((len(docs), n))
                docs.append((len(docs), " ".join(["some", "words", *(f"x{i}" if i in gone else w for i, w in enumerate(words)), "end"])))
        docs += [(len(docs), " ".join(f"x{i}" if i <= n // 4 else w for i, w in enumerate(words)))]
    assert pairs(spark, docs, spark.createDataFrame(items, "item_id long, text string")) == want


def test_toxic_is_not_trusted(spark):
    docs = spark.createDataFrame([(1, "good plain words"), (2, "venom and spite"), (3, "more plain words"), (4, "spite again")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, None), (4, 1, 0), (4, None, 1)], "doc_id long, quality int, toxic int")
    assert quality.log_ratios(docs, labels) == quality.log_ratios(docs, labels.filter("doc_id in (1, 3)"))


def test_short_lines_on_request(spark):
    """A caller who asks for lines below five words gets all of them."""
    rows = [(i, t) for i, t in enumerate(["All rights reserved.\nok\na b c d", "ok\n\nall RIGHTS reserved.", "d c b a\na b c d e\n}", "}\nok then", None, "e a b c d"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (1, 2, 4, 5):
        got = {(r["doc_id"], r["line"]) for r in lines.removed_lines(docs, min_words=least).collect()}
        assert got == brute.removed_lines(rows, least=least)
