"""The conditional random field against enumeration of all class sequences."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from larkspur.operators import crf
from larkspur.operators.crf import Chains, Model


def chains(seed, k=3, width=11):
    rng = np.random.default_rng(seed)
    sizes = np.array([3, 0, 1, 4, 2, 4])
    counts = rng.integers(0, 4, sizes.sum())
    columns = rng.integers(0, width, counts.sum())
    flat = rng.normal(size=width * k + k * k + 2 * k)
    return flat, sizes, counts, columns, rng.integers(0, k, sizes.sum()), k, width


def enumerated(model, sizes, counts, columns):
    """For each sequence: {classes: log weight}."""
    score = np.array([model.columns[c].sum(0) for c in np.split(columns, np.cumsum(counts)[:-1])])
    out, at = [], 0
    for n in sizes:
        s = score[at : at + n]
        at += n
        weight = lambda y: model.first[y[0]] + model.last[y[-1]] + sum(s[i, c] for i, c in enumerate(y)) + sum(model.steps[a, b] for a, b in itertools.pairwise(y))  # noqa: E731, B023
        out.append({y: weight(y) for y in itertools.product(range(len(model.first)), repeat=n)} if n else {(): 0.0})
    return out


def test_sums_marginals_and_best_equal_enumeration():
    for seed in range(5):
        flat, sizes, counts, columns, y, k, width = chains(seed)
        model = Model.of(list("abc"), flat, width)
        c = Chains(model, sizes, counts, columns)
        every = enumerated(model, sizes, counts, columns)
        assert np.allclose(c.forward(), [np.log(sum(np.exp(v) for v in e.values())) for e in every])
        p, best, at = c.marginals(), c.best(), 0
        for n, e in zip(sizes, every, strict=True):
            z = sum(np.exp(v) for v in e.values())
            for i in range(n):
                assert np.allclose(p[at + i], [sum(np.exp(v) for s, v in e.items() if s[i] == cl) / z for cl in range(k)])
            assert tuple(best[at : at + n]) == max(e, key=e.get)
            at += n


def test_slope_is_the_likelihood_s():
    flat, sizes, counts, columns, y, k, width = chains(9)
    value = lambda x: Chains(Model.of(list("abc"), x, width), sizes, counts, columns).gradient(y)
    v, *parts = value(flat)
    model = Model.of(list("abc"), flat, width)
    at, gold = 0, 0.0
    for n, e in zip(sizes, enumerated(model, sizes, counts, columns), strict=True):
        gold += e[tuple(y[at : at + n].tolist())] - np.log(sum(np.exp(w) for w in e.values()))
        at += n
    assert np.isclose(v, gold)
    slope = np.concatenate([p.ravel() for p in parts])
    for i in range(len(flat)):
        step = np.zeros(len(flat))
        step[i] = 1e-5
        assert np.isclose((value(flat + step)[0] - value(flat - step)[0]) / 2e-5, slope[i], atol=1e-5)


def test_minimise_finds_the_least():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(8, 8))
    a = a @ a.T + np.eye(8)
    b = rng.normal(size=8)
    x = crf.minimise(lambda x: (0.5 * x @ a @ x - b @ x, a @ x - b), np.zeros(8), 100, 1e-12)
    assert np.allclose(x, np.linalg.solve(a, b), atol=1e-3)


def texts(spark, n=120):
    """The class of a word is that of the last of two switch words before it: a word by itself doesn't tell."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        now, words, y = "", [], []
        for _ in range(int(rng.integers(0, 14))):
            w = str(rng.choice(["on", "off", "x", "y", "z"]))
            now = {"on": "up", "off": "down"}.get(w, now)
            words.append(w)
            y.append(now or "down")
        rows.append((i, words, y))
    return spark.createDataFrame(rows, "identifier long, w array<string>, y array<string>").withColumn("features", crf.text_features(F.col("w")))


def test_train_tag_save(spark, tmp_path):
    rows = texts(spark)
    model = crf.train(rows.where("identifier < 90"), l2=0.1, width=512)
    assert model.classes == ["down", "up"]
    got = {r["identifier"]: r for r in crf.tag(rows.drop("y"), model).collect()}
    pairs = [(a, b) for r in rows.where("identifier >= 90").collect() for a, b in zip(r["y"], got[r["identifier"]]["y"], strict=True)]
    assert sum(a == b for a, b in pairs) > 0.97 * len(pairs) and len(pairs) > 100
    assert all(0.3 < p <= 1 + 1e-9 for r in got.values() for p in r["p"])
    crf.save_model(spark, model, f"{tmp_path}/m")
    again = crf.load_model(spark, f"{tmp_path}/m")
    assert again.classes == model.classes and np.allclose(again.flat(), model.flat())
    # the weights don't depend on how the rows are dealt
    other = crf.train(rows.where("identifier < 90").repartition(7), l2=0.1, width=512)
    assert np.allclose(other.flat(), model.flat(), atol=1e-2)


def test_nothing_to_learn_from(spark):
    none = texts(spark, 3).limit(0)
    model = crf.train(none, width=64)
    assert model.classes == [""] and crf.tag(none, model).collect() == []
    row = spark.createDataFrame([(1, [], [])], "identifier long, w array<string>, y array<string>").withColumn("features", crf.text_features(F.col("w")))
    assert [tuple(r) for r in crf.tag(row, model).collect()] == [(1, [], [])]
