"""Classifiers, perceptrons, evolution, mutual information."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import classify, evolve, features, results


def rows(spark, n=240):
    rng = random.Random(1)
    out = []
    for i in range(n):
        y = i % 2
        out.append((i, [f"w{rng.randrange(60)}" for _ in range(6)] + (["good"] if y else ["bad"]) * (rng.random() < 0.95), float(y), "en" if i % 3 else "fr"))
    return spark.createDataFrame(out, "identifier long, tokens array<string>, y double, domain string")


@pytest.mark.parametrize("name", ["NaiveBayes", "Logistic"])
def test_benchmarks(spark, name):
    r = classify.benchmark(rows(spark), name, 2).first()
    assert r["total_number_of_instances"] == 240 and r["percent_correctly_classified"] > 85 and 0.85 < r["area_under_curve"] <= 1
    assert list(r.asDict()) == results.RESULT_COLUMNS and r["positive_instances"] == 120


def test_cross_domain_and_confidences(spark):
    r = classify.cross_domain(rows(spark), "NaiveBayes", "en", "fr").first()
    assert r["total_number_of_instances"] == 80 and r["percent_correctly_classified"] > 80 and (r["train_domain"], r["test_domain"]) == ("en", "fr")
    c = classify.classify(rows(spark).withColumn("s", (F.col("identifier") % 4 == 0).cast("int")), "s")
    assert c.count() == 60 and c.where("abs(positive + negative - 1) > 1e-6").count() == 0


def test_nearest_neighbours(spark):
    train = spark.createDataFrame([(1, ["a", "b"], 1.0), (2, ["c"], 0.0), (3, ["d"], 0.0)], "identifier long, tokens array<string>, y double")
    test = spark.createDataFrame([(9, ["a", "x"], 1.0), (10, ["zz"], 0.0)], "identifier long, tokens array<string>, y double")
    assert {r[0]: r[1] for r in classify.nearest(train, test).collect()} == {9: 1.0, 10: 0.0}


def brute_nearest(train, test, k):
    counts = Counter(y for _, _, y in train)
    most = min(counts, key=lambda y: (-counts[y], y))
    out = {}
    for i, tokens in test:
        near = sorted((-s, t, y) for t, other, y in train if (s := len(set(tokens) & set(other))))[:k]
        votes = Counter(y for _, _, y in near)
        out[i] = max(votes, key=lambda y: (votes[y], y)) if votes else most
    return out


def test_nearest_neighbours_count_frequent_tokens(spark):
    rng = random.Random(5)

    def tokens():
        return [f"f{j}" for j in range(6) if rng.random() < 0.4] + [f"r{rng.randrange(40)}" for _ in range(rng.randrange(3))]

    train = [(i, tokens(), float(rng.random() < 0.4)) for i in range(150)]
    test = [(1000 + i, tokens()) for i in range(60)] + [(2000, []), (2001, ["f0"]), (2002, ["zz"])]
    a = spark.createDataFrame(train, "identifier long, tokens array<string>, y double")
    b = spark.createDataFrame(test, "identifier long, tokens array<string>")
    for k, side in ((1, 1 << 14), (3, 40)):
        assert {r[0]: r[1] for r in classify.nearest(a, b, k, side=side).collect()} == brute_nearest(train, test, k)


def test_unknown_classifiers_are_refused():
    with pytest.raises(ValueError):
        classify.estimator("__import__('os')")


def test_measures_by_hand(spark):
    rows = [(1.0, 1.0, 0.9), (1.0, 0.0, 0.4), (0.0, 0.0, 0.4), (0.0, 0.0, 0.1), (0.0, 1.0, 0.6)]
    r = results.measures(spark.createDataFrame(rows, "y double, prediction double, p double").repartition(3), "x", 4, 7).first()
    assert (r["correctly_classified_instances"], r["incorrectly_classified_instances"], r["neutral_instances"]) == (3, 2, 0)
    err = [abs(y - p) for y, _, p in rows]
    assert r["mean_absolute_error"] == pytest.approx(sum(err) / 5) and r["root_mean_squared_error"] == pytest.approx((sum(e * e for e in err) / 5) ** 0.5)
    assert r["relative_absolute_error"] == pytest.approx(100 * sum(err) / (2 * 0.6 + 3 * 0.4)) and r["root_relative_squared_error"] == pytest.approx(100 * (sum(e * e for e in err) / (2 * 0.36 + 3 * 0.16)) ** 0.5)
    pairs = [(p, n) for y, _, p in rows if y for z, _, n in rows if not z]
    assert r["area_under_curve"] == pytest.approx(sum(1.0 if p > n else 0.5 if p == n else 0 for p, n in pairs) / 6)
    assert (r["precision"], r["recall"], r["true_negative_rate"]) == (0.5, 0.5, pytest.approx(2 / 3))


def test_names_of_classifiers(spark):
    assert [classify.known(x) for x in ("weka.classifiers.trees.J48 -C 0.25", "GaussianNB()", "neighbors.KNeighborsClassifier()")] == ["J48", "GaussianNB", "KNeighbors"]
    assert classify.mean_accuracy(rows(spark, 60), "GaussianNB()", 2).first()["accuracy"] > 0.6
    signs = spark.createDataFrame([(1, -1, -1, 1), (-1, 1, -1, -1), (-1, -1, 1, 0), (-1, -1, -1, 0), (1, 1, -1, 1)], "p int, n int, e int, want int")
    assert signs.where(classify.one_vs_rest(F.col("p"), F.col("n"), F.col("e")) != F.col("want")).count() == 0


def test_perceptron():
    x = np.array([[0, 0], [0, 1], [1, 0], [1, 1]], float)
    y = np.array([-1, -1, -1, 1])
    w = classify.perceptron(x, y)
    assert (np.sign(np.hstack([x, np.ones((4, 1))]) @ w) == y).all()


def test_pivot_perceptrons(spark):
    df = spark.createDataFrame([([1.0, 0.0], ["p"]), ([0.0, 1.0], ["q"]), ([1.0, 1.0], ["p", "q"])], "features array<double>, words array<string>")
    got = {r["pivot"]: r["weights"] for r in classify.pivot_perceptrons(df, ["p", "q"]).collect()}
    assert set(got) == {"p", "q"} and all(len(w) == 3 for w in got.values())


def test_evolution_improves(spark):
    data = [([0, 1], 1), ([0, 2], 1), ([3], -1), ([3, 4], -1)] * 10
    sentences = spark.createDataFrame(data, "ids array<int>, y int").repartition(2)
    s = evolve.Settings(population=12, generations=4, children=6, seed=3)
    first = evolve.fitness(sentences, np.random.default_rng(3).uniform(-1, 1, (12, 5))).max()
    genome, value = evolve.evolve(sentences, 5, s)
    assert value >= first and value > 50
    assert evolve.genome_rows(["a"], np.array([0.5])) == ["a\t0\t0.5"]
    del genome


def test_fitness_by_broadcast_and_by_join(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [(rng.integers(0, 30, rng.integers(0, 9)).tolist(), int(rng.choice([-1, 1]))) for _ in range(200)]
    sentences = spark.createDataFrame(data, "ids array<int>, y int").repartition(3)
    g = np.round(rng.uniform(-1, 1, (4, 30)), 3)
    want = [100 * sum(np.sign(x[ids].sum()) == y for ids, y in data) / 200 for x in g]
    assert evolve.fitness(sentences, g) == pytest.approx(want)
    monkeypatch.setattr(evolve, "CELLS", 0)
    assert evolve.fitness(sentences, g) == pytest.approx(want)


def test_meta_classifiers_and_folds(spark, monkeypatch, tmp_path):
    rng = random.Random(6)
    rows = [(i, rng.choice([1, -1]), [round(rng.uniform(-1, 1), 2) for _ in range(rng.randrange(7))]) for i in range(90)]
    df = spark.createDataFrame(rows, "identifier long, y int, signal array<double>").withColumn("k", evolve.sign_change_column(F.col("signal")))
    assert {r["identifier"]: r["k"] for r in df.collect()} == {i: evolve.sign_changes(np.array(s)) for i, _, s in rows}
    train, test = rows[:60], rows[60:]

    def plain(group):
        out = {}
        for i, _, s in test:
            near = [(round(evolve.correlation(np.array(t), np.array(s)), 12), -j, y) for j, y, t in train if group(t) == group(s)]
            out[i] = max(near)[2] if near else None
        return out

    for side, group, key in ((4096, None, lambda s: 0), (16, "k", lambda s: evolve.sign_changes(np.array(s)))):
        monkeypatch.setattr(evolve, "SIDE", side)
        got = evolve.nearest_signals(df.where("identifier < 60"), df.where("identifier >= 60"), group)
        assert {r["identifier"]: r["prediction"] for r in got.collect()} == plain(key)
    folds = evolve.k_cross(df, evolve.nearest_signals, 3).collect()
    assert sum(r["total"] for r in folds) == 90 and all(r["percent"] == pytest.approx(100 * r["correct"] / r["total"]) for r in folds)
    assert evolve.self_evaluation(df.where("size(signal) > 3"), evolve.nearest_signals).first()["percent"] == 100
    none = evolve.percent_correct(spark.createDataFrame([(1, 1), (1, None), (-1, 1)], "y int, prediction int")).first()
    assert (none["correct"], none["decided"], none["percent"]) == (1, 2, pytest.approx(100 / 3))


def test_genomes_go_out_and_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "good day"), (2, -1, "bad"), (3, 1, "")], "identifier long, y int, document string")
    words, sentences = evolve.enumerated(df, F.filter(F.split("document", " "), lambda w: w != ""))
    assert {r["word"]: r["id"] for r in words.collect()} == {"bad": 0, "day": 1, "good": 2}
    assert {r["identifier"]: r["ids"] for r in sentences.collect()} == {1: [2, 1], 2: [0], 3: []}
    scores = spark.createDataFrame([(0, -0.5), (1, 0.25), (2, 0.75)], "id long, score double")
    evolve.exported_genome(words, scores).select("value").write.text(str(tmp_path / "g"))
    assert sorted(tuple(r) for r in evolve.read_genome(spark, str(tmp_path / "g")).collect()) == [("bad", 0, -0.5), ("day", 1, 0.25), ("good", 2, 0.75)]
    assert {r["identifier"]: r["signal"] for r in evolve.signals(sentences, scores).collect()} == {1: [0.75, 0.25], 2: [-0.5], 3: []}


def test_signals():
    assert evolve.correlation(np.array([1.0, 2, 3]), np.array([2.0, 4, 6])) == pytest.approx(1)
    assert evolve.nearest_signal([np.array([1.0, 2, 3]), np.array([3.0, 2, 1])], [1, -1], np.array([1.0, 3, 9])) == 1
    assert evolve.sign_changes(np.array([1, 0, -1, -2, 3])) == 2


def test_mutual_information(spark):
    p = spark.createDataFrame([(1, "f"), (2, "f"), (1, "g"), (3, "g")], "identifier long, feature string")
    y = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "identifier long, label int")
    got = {r["feature"]: r["mi"] for r in features.mutual_information(p, y).collect()}
    assert got["f"] == pytest.approx(math.log(2)) and got["g"] == pytest.approx(0)
