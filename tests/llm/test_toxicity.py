"""Held-out accuracy, and the trainer against a plain version."""

import math
import random

import numpy as np

from larkspur.llm import toxicity as tox


def words(rng, n, bad):
    w = [f"w{int(rng.random() ** 2 * 300)}" for _ in range(n)]
    for _ in range(bad):
        w[rng.randrange(n)] = rng.choice(["idiot", "scum!", "MORON", "clown,"])
    return " ".join(w)


def corpus(n=900):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.2)
        rows.append((i, words(rng, rng.randrange(20, 120), 3 if y else 0), y))
    return rows


def plain_ftrl(rows, epochs):
    z, n = {}, {}

    def weight(i, l1):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((tox.BETA + math.sqrt(n.get(i, 0.0))) / tox.ALPHA + tox.L2)

    for _ in range(epochs):
        for y, at in rows:
            w = {i: weight(i, tox.L1) for i in at} | {"b": weight("b", 0)}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i, wi in w.items():
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / tox.ALPHA * wi
                n[i] = old + g * g
    return {i: weight(i, tox.L1) for i in z if i != "b"}, weight("b", 0)


def test_trainer_equals_a_plain_one():
    rng = np.random.default_rng(1)
    rows = [(float(rng.integers(2)), np.unique(rng.integers(0, 60, 8))) for _ in range(200)]
    w, b = tox.ftrl(rows, 2)
    want, bias = plain_ftrl([(y, at.tolist()) for y, at in rows], 2)
    assert abs(b - bias) < 1e-9
    assert all(abs(w[i] - v) < 1e-9 for i, v in want.items())
    assert np.count_nonzero(w) == sum(v != 0 for v in want.values())


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = tox.toxicity(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert 150 < len(held) < 300
    truth = {r[0]: r[2] for r in rows}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_held_out_labels_never_train(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    first = {r["doc_id"]: (r["held_out"], r["score"]) for r in tox.toxicity(docs, labels).collect()}
    changed = spark.createDataFrame([(r[0], 1 - r[2] if first[r[0]][0] else r[2]) for r in rows], "doc_id long, toxic int")
    assert {r["doc_id"]: (r["held_out"], r["score"]) for r in tox.toxicity(docs, changed).collect()} == first


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "...", "z"), (3, "...", "z"), (None, "a", None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    got = tox.toxicity(docs, labels).collect()
    assert len(got) == 5 and len({r["score"] for r in got if not r["text"] or r["text"] == "..."}) == 1
    assert tox.toxicity(docs.limit(0), labels.limit(0)).count() == 0
    assert [r["score"] for r in tox.toxicity(docs, labels.limit(0)).collect()] == [0.5] * 5
