"""The end of the search for scores of words and pairs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larkspur.operators import annotations as A
from larkspur.operators import normalise, phrases

TEXTS = [(1, "The running dog #Tag @me !!"), (2, "running dog bites running Dog"), (3, "one"), (4, "dog bites  dog"), (5, None)]
MARKS = [(1, "qppqqq"), (2, "qnqppq"), (2, "pnq"), (3, "p"), (4, "pqqp"), (6, "pp")]


def _tables(spark):
    return spark.createDataFrame(TEXTS, "identifier long, document string"), spark.createDataFrame(MARKS, "identifier long, annotation string")


def test_pairs_are_summed_as_their_rows(spark):
    df, marks = _tables(spark)
    rows = phrases.evolution_targets(phrases.evolution_pairs(df), A.subjectivity_vector(marks)).withColumn("m", (F.col("a1") + F.col("a2")) / 2)
    want = rows.groupBy("ij").agg(F.count("*").alias("n"), F.sum("a1"), F.sum("a2"), F.sum("m"), F.sum(F.col("m") * F.col("m"))).collect()
    got = {r["ij"]: tuple(r[x] for x in ("n", "s1", "s2", "t", "tt")) for r in phrases.evolution_sums(df, marks).collect()}
    assert got.keys() == {r["ij"] for r in want} and all(got[r["ij"]] == pytest.approx(tuple(r[1:])) for r in want)


def test_a_word_alone_is_as_in_its_text(spark):
    words = ["The", "running", "a@b", "#Runs", "!!", "", "RÉSUMÉS", "it's", "x#@", "Σίσυφος", "ties"]
    text = spark.createDataFrame([(" ".join(words),)], "t string").select(normalise.evolution_words(F.col("t"))).first()[0]
    assert [normalise.evolution_word(w) for w in words] == text


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_the_search_ends_at_the_least_error(spark, monkeypatch, few):
    monkeypatch.setattr(phrases, "FEW_KEYS", few)
    df, marks = _tables(spark)
    sums = phrases.evolution_sums(df, marks).collect()
    best = {r["key"]: (r["n"], r["score"]) for r in phrases.evolve(df, marks).collect()}
    first = {r["key"]: (r["n"], r["score"]) for r in phrases.evolve(df, marks, 0).collect()}
    assert {k: n for k, (n, _) in best.items()} == {k: n for k, (n, _) in first.items()}

    def error(scores):
        out = 0.0
        for r in sums:
            three = [scores[r[x]] for x in ("ij", "i", "j")]
            s = sum(n * v for n, v in three) / sum(n for n, _ in three)
            out += r["n"] * s * s - 2 * s * r["t"] + r["tt"]
        return out

    least = sum(r["tt"] - r["t"] * r["t"] / r["n"] for r in sums)
    assert error(best) == pytest.approx(least) and error(first) > least + 0.01
    made = {r["identifier"]: r["annotation"] for r in phrases.evolved(df, phrases.evolve(df, marks)).collect()}
    assert made[3] == [0.0] and made[4][0] == pytest.approx(next(r["t"] / r["n"] for r in sums if r["ij"] == "dog bite"))
