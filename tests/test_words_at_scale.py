"""Words of a text are looked up within it: they are no rows that are shuffled."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.operators import annotations as A
from larkspur.operators import tokens

TEXTS = [(1, "a bb  ccc"), (2, ""), (3, None), (4, "née über a"), (5, "x")]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(TEXTS, "identifier long, document string")


def exchanges(df) -> int:
    return df._jdf.queryExecution().sparkPlan().toString().count("Exchange") + df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_offsets_and_nearest_words_shuffle_nothing(texts):
    o = A.offsets(texts)
    assert sorted((r["identifier"], r["at"], r["word"], r["start"]) for r in o.collect()) == [
        (1, 0, "a", 0), (1, 1, "bb", 2), (1, 2, "", 5), (1, 3, "ccc", 6), (2, 0, "", 0), (4, 0, "née", 0), (4, 1, "über", 4), (4, 2, "a", 9), (5, 0, "x", 0),
    ]
    asked = lambda s: F.transform(s, lambda x, at: x + (at * 5) % 7)
    near = A.nearest_words(texts, asked)
    rows = o.select("identifier", (F.col("start") + (F.col("at") * 5) % 7).alias("start")).distinct()
    want = A.nearest(rows, o.select("identifier", "start", "at")).select("identifier", "start", "at")
    assert sorted(near.collect()) == sorted(want.collect())
    assert exchanges(o) == 0 and exchanges(near) == 0


def test_of_two_equally_near_starts_the_earlier(spark):
    rows = spark.createDataFrame([(1, [3, -1, 9], [2, 4]), (2, [1], []), (3, [], [5]), (4, [0, 7], [5])], "i long, a array<long>, s array<long>")
    found = rows.select("i", A.nearest_places(F.col("a"), F.col("s")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in found} == {1: [0, 0, 1], 2: [], 3: [], 4: [0, 0]}


def test_sequences_and_their_texts_shuffle_no_tokens(texts):
    names, seq = tokens.tokenised(texts, X.tweet_tokens(F.col("document")))
    assert exchanges(seq) == 0 and exchanges(tokens.spelled(seq, names)) == 0
    held = {r["identifier"]: r["token"] for r in names.collect()}
    assert {r["document_identifier"]: [held[t] for t in r["tokens"]] for r in seq.collect()} == {1: ["a", "bb", "ccc"], 2: [], 3: [], 4: ["n", "über", "a"], 5: ["x"]}
    assert {r["document_identifier"]: r["tokens"] for r in tokens.spelled(seq, names).collect()} == {1: ["a", "bb", "ccc"], 2: [], 3: [], 4: ["n", "über", "a"], 5: ["x"]}


@pytest.mark.parametrize("most", [0, 1, 2, 100])
def test_values_beyond_those_that_are_sent_are_joined(spark, most):
    rows = spark.createDataFrame([(1, ["a", "b", "a", "z"]), (2, []), (3, None), (4, ["c", "a", "b"])], "k long, w array<string>")
    table = spark.createDataFrame([("a", 7), ("b", 8), ("c", 9)], "w string, k long")  # names are those of the rows
    found = tokens.replaced(rows, "k", "w", table, most)
    assert {r["k"]: r["w"] for r in found.collect()} == {1: [7, 8, 7, None], 2: [], 3: [], 4: [9, 7, 8]}


def test_many_ids_are_dropped_without_joining_tokens(spark, monkeypatch):
    monkeypatch.setattr(tokens, "FEW", 1)
    seq = spark.createDataFrame([(1, 1, [3, 1, 2, 3]), (2, 2, [])], "identifier long, document_identifier long, tokens array<long>")
    kept = tokens.without_tokens(seq, spark.createDataFrame([(3,), (1,), (9,)], "identifier long"))
    assert exchanges(kept) == 0
    assert {r["identifier"]: r["tokens"] for r in kept.collect()} == {1: [2], 2: []}
