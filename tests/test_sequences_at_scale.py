"""What grows with the length of a text in the sequence labeller."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from larkspur.operators import crf, phrases


def test_a_text_is_split_once_for_all_its_words(spark):
    made = spark.createDataFrame([(1, "a b c")], "identifier long, document string").select(crf.text_features(F.split("document", " ")).alias("f"))
    assert made._jdf.queryExecution().analyzed().toString().count("split(") == 1
    both = spark.createDataFrame([(["a", "b"], ["X", "Y"])], "w array<string>, t array<string>").select(crf.text_features(F.reverse("w"), F.reverse("t")).alias("f"))
    assert both._jdf.queryExecution().analyzed().toString().count("reverse(") == 2
    assert both.first()["f"][0] == ["w=b", "low=b", "any", "w[1]=a", "ww[1]=b|a", "first", "t[0]=Y", "t[1]=X"]


def test_agreement_joins_texts_not_words(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0, 1.0]), (2, [1.0]), (3, [])], "identifier long, annotation array<double>")
    o = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 1.0]), (4, [1.0])], "identifier long, annotation array<double>")
    made = phrases.agreement(p, o)
    assert made.select("tp", "tn", "fp", "fn").first() == (1, 0, 1, 1)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # words are made above the join


def test_sequences_of_a_batch_are_as_each_alone():
    rng = np.random.default_rng(3)
    k, width, sizes = 3, 32, np.array([4, 0, 7, 1, 7])
    counts = rng.integers(0, 4, sizes.sum())
    columns, y = rng.integers(0, width, counts.sum()), rng.integers(0, k, sizes.sum())
    model = crf.Model.of(list("abc"), rng.normal(size=width * k + k * k + 2 * k), width)
    at, upto = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(counts)])
    whole = crf.Chains(model, sizes, counts, columns).gradient(y)
    parts = [crf.Chains(model, sizes[i : i + 1], counts[a:z], columns[upto[a] : upto[z]]).gradient(y[a:z]) for i, (a, z) in enumerate(zip(at[:-1], at[1:], strict=True)) if z > a]
    for got, want in zip(whole, (sum(x) for x in zip(*parts, strict=True)), strict=True):
        assert np.allclose(got, want)
