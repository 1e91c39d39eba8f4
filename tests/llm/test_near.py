"""Groups of near copies whose similarities stand about the threshold, against brute force."""

import random

import pytest

import brute
from sablefin.llm import minhash


def near_copies(rng, base, n, changes):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.choice(changes)):
            at = rng.randrange(len(w))
            kind = rng.random()
            if kind < 0.6:
                w[at] = f"x{rng.randrange(10**6)}"
            elif kind < 0.8:
                del w[at]
            else:
                w.insert(at, f"y{rng.randrange(40)}")
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("words", "percent", "seed"), [(3, 85, 1), (5, 80, 2)])
def test_groups_about_the_threshold(spark, words, percent, seed):
    rng = random.Random(seed)
    texts = []
    for size, n, changes in ((60, 90, (2, 3)), (148, 90, (4, 5)), (148, 60, (7, 8)), (30, 50, (1,)), (400, 30, range(12, 16))):
        base = [f"b{size}n{n}w{i}" for i in range(size)]
        texts += near_copies(rng, base, n, changes)
    text = [f"c{i}" for i in range(150)]  # a chain: each link is made from the one before
    for _ in range(40):
        text = near_copies(rng, text, 1, (2, 3, 4))[0].split(" ")
        texts.append(" ".join(text))
    rng.shuffle(texts)
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, words, percent).collect()}
    assert got == brute.near(rows, words, percent)


def test_all_pairs_of_differences(spark):
    """Without stars the join of differences finds the components alone, regions and repeated ids included."""
    rng = random.Random(5)
    texts = []
    for size, n, changes in ((50, 60, (1, 2, 3)), (90, 60, (0, 2, 4, 6))):
        texts += near_copies(rng, [f"b{size}w{i}" for i in range(size)], n, changes)
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0], rows[0]], "doc_id long, text string")
    rest = spark.createDataFrame([(i, 1 if i < 60 else 1 + i % 2, i) for i, _ in rows] + [(i, 2, i) for i, _ in rows[:30]], "id long, key long, label long")
    links = [(r["a"], r["b"]) for r in minhash.difference_links(rest, docs, 3, 85).collect()]
    sets = {i: brute.shingles(t, 3) for i, t in rows}
    assert all(100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) for a, b in links)
    assert brute.roots(sets, links) == {d: c for d, (_, c) in brute.near(rows, 3, 85).items()}
