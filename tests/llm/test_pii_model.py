"""The label model and the classifier on planted votes, and overlaps of added spans."""

import random

import pytest
from pyspark.sql import functions as F

from sablefin.llm import pii


def planted(accuracy, abstains, prior, n, seed):
    """Vote patterns of labelers with known accuracies over items with known labels."""
    rng = random.Random(seed)
    counts, truth = {}, {}
    for _ in range(n):
        kind = rng.choice(list(prior))
        label = rng.random() < prior[kind]
        votes = tuple(0 if rng.random() < q else (1 if label == (rng.random() < a) else -1) for a, q in zip(accuracy, abstains, strict=True))
        counts[kind, votes] = counts.get((kind, votes), 0) + 1
        truth.setdefault((kind, votes), []).append(label)
    return [(k, v, n) for (k, v), n in sorted(counts.items())], truth


def test_reliabilities_are_found():
    accuracy, abstains, prior = (0.95, 0.7, 0.85, 0.6), (0.1, 0.3, 0.2, 0.1), {"ssn": 0.7, "name": 0.3}
    patterns, truth = planted(accuracy, abstains, prior, 40_000, 3)
    table, found, post = pii.reliabilities(patterns)
    for i, a in enumerate(accuracy):
        right = table[i, 1, 1] / (table[i, 1, 1] + table[i, 1, -1])
        assert right == pytest.approx(a, abs=0.04)
    assert found["ssn"] == pytest.approx(0.7, abs=0.04) and found["name"] == pytest.approx(0.3, abs=0.04)
    for key, labels in truth.items():
        if len(labels) >= 300:
            assert post[key] == pytest.approx(sum(labels) / len(labels), abs=0.08)


def test_classifier_follows_the_labels(spark):
    patterns, _ = planted((0.9, 0.8, 0.7, 0.7), (0.1, 0.2, 0.2, 0.1), {"ssn": 0.6, "iban": 0.4}, 20_000, 4)
    _, _, post = pii.reliabilities(patterns)
    weight = pii.span_classifier(patterns, post)
    rows = [(k, *v) for k, v, _ in patterns]
    df = spark.createDataFrame(rows, "kind string, " + ", ".join(f"{v} int" for v in pii.VOTERS))
    one = df.select(*df.columns, pii.accepted(weight)(F.struct(*df.columns)).alias("yes")).collect()
    sure = [r for r in one if abs(post[r["kind"], tuple(r[v] for v in pii.VOTERS)] - 0.5) > 0.4]
    right = [r["yes"] == (post[r["kind"], tuple(r[v] for v in pii.VOTERS)] > 0.5 and r["shape"] > 0) for r in sure]
    assert sum(right) >= 0.97 * len(right)


def test_no_candidates():
    assert pii.reliabilities([])[2] == {} and pii.span_classifier([], {}) == {}


def test_overlaps(spark):
    spans = [(5, 9, "ssn"), (0, 4, "name"), (2, 12, "iban"), (3, 4, "ssn"), (9, 10, "name"), (0, 6, "iban")]
    df = spark.createDataFrame([([{"s": s, "e": e, "k": pii.KINDS.index(k), "kind": k} for s, e, k in spans],), ([],)], "x array<struct<s:int,k:int,kind:string,e:int>>")
    got = [[(x["s"], x["e"]) for x in r["y"]] for r in df.select(pii.apart(F.col("x")).alias("y")).collect()]
    assert got == [[(0, 6), (9, 10)], []]
