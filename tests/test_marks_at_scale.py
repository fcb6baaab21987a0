"""Marks of words are counted within a document: no word or mark is a row that is shuffled or joined."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import annotations as A
from larkspur.operators import features, phrases


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def given(spark):
    d = spark.createDataFrame([(1, "A b a  c"), (2, "x"), (3, "é Ω"), (None, "n"), (4, None), (5, "no marks")], "identifier long, document string")
    a = spark.createDataFrame([(1, "pnpqpp"), (1, "nq^"), (1, None), (3, "ep"), (3, "pe"), (2, ""), (None, "p"), (4, "p"), (9, "p")], "identifier long, annotation string")
    return d, a


def test_discrete_marks_without_a_join_of_positions(spark):
    made = features.discrete_marks(*given(spark))
    assert "Join" not in plan(made) and plan(made).count("Exchange hash") == 1
    assert sorted(map(tuple, made.collect())) == [(1, "", "q"), (1, "a", "p"), (1, "b", "q"), (1, "c", "p"), (3, "é", "q"), (3, "ω", "q")]


def test_word_shares_without_a_join_of_positions(spark):
    made = features.word_shares(*given(spark))
    assert "Join" not in plan(made) and plan(made).count("Exchange hash") == 1
    assert {(r[0], r[1]): tuple(r)[2:] for r in made.collect()}[1, "a"] == (1.0, 0.0, 0.5)


def test_word_rates_shuffle_words_only(spark):
    made = phrases.word_rates(*given(spark))
    assert "Join" not in plan(made)
    assert {r["word"]: r["rate"] for r in made.collect()} == {"a": 1.0, "b": 0.5, "": 0.0, "c": 1.0, "é": 1.0, "ω": 1.0}


def test_union_votes_meet_in_one_shuffle(spark):
    made = A.union_votes(given(spark)[1])
    assert plan(made).count("Exchange hash") == 1
    got = {(r["identifier"], r["at"]): r["mark"] for r in made.where("identifier = 1").collect()}
    assert got == {(1, 0): "p", (1, 1): "n", (1, 2): "p", (1, 3): "q", (1, 4): "p", (1, 5): "p"}


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
def test_pieces_of_a_batch_give_the_same(spark, limit, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(A, "CHARACTERS", limit)
    lists = pa.array([["pq", "qqe"], [], None, ["n"]])
    got = [A._placed(lists.slice(lo, hi - lo))[0].tolist() for lo, hi in A._ranges(lists)]
    assert sum(got, []) == [3, 0, 0, 1]


def test_repeated_identifiers_count_together(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "b a")], "identifier long, document string")
    a = spark.createDataFrame([(1, "pq")], "identifier long, annotation string")
    assert sorted(map(tuple, features.discrete_marks(d, a).collect())) == [(1, "a", "q"), (1, "b", "q")]
    assert {r["word"]: r["rate"] for r in phrases.word_rates(d, a).collect()} == {"a": 0.5, "b": 0.5}


def test_markov_of_rare_and_common_words_agree(spark):
    import numpy as np

    d = spark.createDataFrame([(k, " ".join(f"w{chr(97 + (k * j) % 7)} Good" for j in range(k % 5 + 1))) for k in range(40)] + [(50, None), (51, "")], "identifier long, document string")
    a = spark.createDataFrame([(k, "pqqpnqqqpp"[k % 3 :]) for k in range(30)], "identifier long, annotation string")
    model = phrases.markov_model(phrases.labelled_words(d, A.share_vectors(a)))
    got = [{r["identifier"]: r["annotation"] for r in phrases.markov(d, model, common=n).collect()} for n in (0, 3, 1000)]
    assert got[0] == got[1] == got[2] and 50 not in got[0] and len(got[0][51]) == 1
    trans, emission = model
    e = {(r["word"], r["class"]): r["e"] for r in emission.collect()}
    for r in d.where("document IS NOT NULL").collect():
        rows = np.array([[e.get(("".join(c for c in w.lower() if c.isalpha()), k), -12.0) for k in range(phrases.CLASSES)] for w in r["document"].split(" ")])
        assert got[0][r["identifier"]] == [c / 10 for c in phrases.viterbi(trans, rows)]


def test_labelled_words_match_the_columns(spark):
    d, a = given(spark)
    d = d.union(spark.createDataFrame([(6, "  Big Cat 9 sat Kİn On-it "), (7, "")], d.schema))
    a = a.union(spark.createDataFrame([(6, "qpqpqpqpqp"), (6, "pppp"), (7, "p")], a.schema))
    shares = A.share_vectors(a)
    rows = d.join(shares, "identifier").select("identifier", "annotation", F.inline(phrases.counted_words(F.col("document")))).withColumn("p", F.get("annotation", F.col("at"))).where("p IS NOT NULL")
    want = sorted((r["identifier"], r["at"], r["word"]) for r in rows.collect())
    made = phrases.labelled_words(d, shares)
    assert sorted((r["identifier"], r["at"], r["word"]) for r in made.collect()) == want and len(want) > 4
    assert "counted" not in plan(made) and "ArrowEvalPython" in plan(made)


def test_evolution_reads_texts_once_for_sums_of_distinct_pairs(spark):
    d = spark.createDataFrame([(k, "good day good day bad") for k in range(6)] + [(9, "day"), (10, "x y")], "identifier long, document string")
    a = spark.createDataFrame([(k, "pqnqp"[k % 2 :]) for k in range(6)] + [(9, "p")], "identifier long, annotation string")
    sums = {r["ij"]: r for r in phrases.evolution_sums(d, a).collect()}
    rows = phrases.evolution_targets(phrases.evolution_pairs(d), A.subjectivity_vector(a)).collect()
    assert sorted(sums) == sorted({r["ij"] for r in rows})
    for ij, r in sums.items():
        own = [x for x in rows if x["ij"] == ij]
        t = [0.5 * (x["a1"] + x["a2"]) for x in own]
        assert r["n"] == len(own) and np.allclose([r["s1"], r["s2"], r["t"], r["tt"]], [sum(x["a1"] for x in own), sum(x["a2"] for x in own), sum(t), sum(x * x for x in t)])
