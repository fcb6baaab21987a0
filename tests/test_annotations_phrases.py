"""Crowd annotations, phrase annotators, verification, features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.operators import annotations as A
from larkspur.operators import features, phrases, results, verify


def ann(spark, *rows):
    return spark.createDataFrame(list(rows), "identifier long, annotation string")


def test_votes_and_ties(spark):
    got = {(r["identifier"], r["at"]): r["mark"] for r in A.union_votes(ann(spark, (1, "pq"), (1, "qq"), (1, "nq"), (2, "e"), (2, "n"), (3, "q"), (3, "q"), (4, "qp"), (4, "qn"))).collect()}
    assert got == {(1, 0): "p", (1, 1): "q", (2, 0): "e", (3, 0): "q", (4, 0): "q", (4, 1): "p"}


def test_identical_annotations_count_once(spark):
    got = A.union_votes(ann(spark, (1, "n"), (1, "n"), (1, "p"))).collect()
    assert [r["mark"] for r in got] == ["p"]


def test_clean(spark):
    d = spark.createDataFrame([("p|q| n^x e",)], "a string")
    assert d.select(A.clean(F.col("a"))).first()[0] == "pqn^qe"


def test_joined_is_cut_or_padded(spark):
    marks = A.union_votes(ann(spark, (1, "pn"), (2, "pnpn")))
    n = spark.createDataFrame([(1, 4), (2, 2)], "identifier long, n int")
    assert {r["identifier"]: r["annotation"] for r in A.joined(marks, n).collect()} == {1: "pnqq", 2: "pn"}


def test_majorities(spark):
    rows = spark.createDataFrame([(1, "positive"), (1, "negative"), (2, "negative"), (2, "negative"), (2, "neutral")], "identifier long, sentiment string")
    assert {r[0]: r[1] for r in A.majority_sentiment(rows).collect()} == {1: "positive", 2: "negative"}
    assert {r[0]: r[1] for r in A.majority_label(rows, "sentiment").collect()} == {1: None, 2: "negative"}
    assert {r[0]: r[1] for r in features.consensus(rows).collect()} == {1: "noconsensus", 2: "negative"}


def test_offsets(spark):
    d = spark.createDataFrame([(1, "ab  c")], "identifier long, document string")
    assert sorted((r["at"], r["word"], r["start"]) for r in A.offsets(d).collect()) == [(0, "ab", 0), (1, "", 3), (2, "c", 4)]


def test_deciles_and_shares(spark):
    d = spark.createDataFrame([(0.0,), (0.1,), (0.101,), (0.5,), (1.0,)], "p double")
    assert [r[0] for r in d.select(X.decile(F.col("p"))).collect()] == [0, 0, 1, 4, 9]


def test_viterbi_by_hand():
    n = phrases.CLASSES
    trans = np.full((n + 2, n + 2), -9.0)
    trans[0, 1], trans[1, 2], trans[2, 1], trans[1, 1], trans[2, n + 1], trans[1, n + 1] = -0.1, -0.2, -0.2, -3.0, -0.1, -2.0
    e = np.full((3, n), -20.0)
    e[:, 0], e[:, 1] = -1.0, -1.0
    assert phrases.viterbi(trans, e) == [0, 1, 0] or phrases.viterbi(trans, e)[0] == 0
    want = max(((a, b, c) for a in range(n) for b in range(n) for c in range(n)), key=lambda s: trans[0, s[0] + 1] + e[0, s[0]] + trans[s[0] + 1, s[1] + 1] + e[1, s[1]] + trans[s[1] + 1, s[2] + 1] + e[2, s[2]] + trans[s[2] + 1, n + 1])
    assert tuple(phrases.viterbi(trans, e)) == want
    assert phrases.viterbi(trans, e[:0]) == []


def test_markov_gives_a_value_for_each_word(spark):
    d = spark.createDataFrame([(1, "good day all"), (2, "bad day")], "identifier long, document string")
    a = ann(spark, (1, "pqq"), (1, "ppq"), (2, "nq"))
    model = phrases.markov_model(phrases.labelled_words(d, A.subjectivity_vector(a)))
    assert {r["identifier"]: len(r["annotation"]) for r in phrases.markov(d, model).collect()} == {1: 3, 2: 2}


def test_fixed_scores(spark, monkeypatch):
    d = spark.createDataFrame([(1, "good, 1 day Good"), (2, "9 !")], "identifier long, document string")
    for limit in (1000, 0):
        monkeypatch.setattr(phrases, "LITERAL", limit)
        got = {r["identifier"]: r["annotation"] for r in phrases.fixed(d, {"good": 0.5, "day": 0.125}, {"good": 0.25, "Good": 9.0}).collect()}
        assert got == {1: [0.5, 0.375, 0.0], 2: []}
        got = {r["identifier"]: r["annotation"] for r in phrases.fixed(d, {"good": 0.5}, legacy=True).collect()}
        assert got == {1: [0.5, 0.0, 0.0, 0.5, 0.0, 0.0], 2: []}


def test_counted_words_and_class_values(spark):
    d = spark.createDataFrame([(1, " The Cat sat, 9 on It")], "identifier long, document string")
    assert [tuple(x) for x in d.select(phrases.counted_words(F.col("document"))).first()[0]] == [(1, "the"), (3, "sat"), (5, "on")]
    shares = spark.createDataFrame([(1, k, p) for k, p in enumerate([1.0, 0.25, 1.0, 0.75, 1.0, 0.5, 1.0])], "identifier long, at int, share double")
    assert sorted((r["at"], r["word"], r["class"]) for r in phrases.labelled_words(d, shares).collect()) == [(1, "the", 2), (3, "sat", 7), (5, "on", 4)]
    assert phrases.human(ann(spark, (1, "pq"), (1, "qq"))).first()["annotation"] == [0.4, 0.0]
    table = spark.createDataFrame([("sat", 7, 1.0)], "word string, class int, score double")
    more = d.union(spark.createDataFrame([(2, "9")], d.schema))
    assert {r["identifier"]: r["annotation"] for r in phrases.bayesian(more, table).collect()} == {1: [0.0, 0.7, 0.0], 2: [0.0]}


def test_all_templates(spark):
    assert len(phrases.WORD_TEMPLATES) == 7 and len(phrases.TAG_TEMPLATES) == 12
    d = spark.createDataFrame([(1, "a b c", ["X", "Y", "Z"])], "identifier long, document string, t array<string>")
    rows = {r["at"]: r["features"] for r in phrases.context_features(d, "t").collect()}
    assert rows[1] == ["w[-1]=a", "w[0]=b", "w[1]=c", "w[-1]|w[0]=a|b", "w[0]|w[1]=b|c", "pos[-1]=X", "pos[0]=Y", "pos[1]=Z", "pos[-1]|pos[0]=X|Y", "pos[0]|pos[1]=Y|Z", "pos[-1]|pos[0]|pos[1]=X|Y|Z"]
    assert rows[0][-1] == "__BOS__" and rows[2][-1] == "__EOS__"


def test_errors_pad_with_zero(spark):
    p = spark.createDataFrame([(1, [0.5])], "identifier long, annotation array<double>")
    o = spark.createDataFrame([(1, [0.0, 1.0])], "identifier long, annotation array<double>")
    assert phrases.squared_error(p, o).first()["error"] == 1.25
    assert phrases.absolute_error(p, o).first()["error"] == 1.5


def test_folds_partition(spark):
    d = spark.range(500).select(F.col("id").alias("identifier"))
    got = d.groupBy(phrases.fold(F.col("identifier"), 5)).count().collect()
    assert len(got) == 5 and sum(r[1] for r in got) == 500


def test_verify_rules(spark):
    six = "one two three four five six"
    rows = [
        ("a b", None, "missing"),
        ("a b", "", "missing"),
        (six, "pppqqq", "too_positive"),
        (six, "nnnnnq", "too_negative"),
        (six, "eeqqqq", "too_neutral"),
        (six, "ppqqqq", None),
        ("a b c d e", "pppqq", None),  # shares count with over five words
        ("a b", "qpp", "whole_tweet"),
        (six, "qq two qq", "copied"),
        ("a b", "a b q", None),  # single characters are no copy
        ("one 2", "q", None),
        ("abcdef g", "nn", "whole_tweet"),
        ("a b c d", "nnnqq", None),  # 3 of 7 characters
        ("a b c d", "qppp", "long_positive"),
        ("a b c d", "ppq ppp", "whole_tweet"),
        ("a b c d e f", "q nnnn", None),
        ("a b c de", "eee", "long_neutral"),
        ("a  b  c  d", "nqnn", None),  # the first run is looked at, of two or more
    ]
    df = spark.createDataFrame([r[:2] + ("w",) for r in rows], "text string, annotation string, worker string")
    assert [r["reason"] for r in verify.verify(df).collect()] == [r[2] for r in rows]
    assert verify.verify(df, ["w"]).where("reason = 'blacklisted'").count() == len(rows) - 2


def test_four_rows(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], s) for i, s in enumerate([1, 2, 3, 5, 9])], "row long, sentiment string, seconds long")
    r = verify.four_row_statistics(df).collect()
    assert len(r) == 1 and r[0]["mean_time"] == 2 and r[0]["entropy"] == 1.0
    assert r[0]["root_sum_square"] == pytest.approx((1 + 0 + 1 + 9) ** 0.5)


def test_confusion(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "y int, p int")
    r = results.confusion(df, "y", "p").first()
    assert (r["tp"], r["fn"], r["fp"], r["tn"]) == (2, 1, 1, 1) and r["precision"] == pytest.approx(2 / 3)


def test_bigram_start_and_stems(spark):
    d = spark.createDataFrame([(1, "one two threes four")], "identifier long, document string")
    o = features.Options(2, 1, threshold=1)
    assert {r["gram"] for r in features.gram_counts(d, o).collect()} == {"two threes", "threes four"}
    s = features.Options(1, threshold=1, stem=True)
    assert {r["gram"] for r in features.gram_counts(d, s).collect()} == {"on", "two", "three", "four"}


def test_special_columns_have_names_of_their_own(spark):
    names = spark.createDataFrame([("overall", 0), ("it's", 2), ("sentiment", 1)], "gram string, feature long")
    head = [r["value"] for r in features.header_lines(names, "r", ["@attribute x_sentiment {a,b}"]).orderBy("place").collect()]
    assert head == ["@relation r", "@attribute w_overall numeric", "@attribute w_sentiment numeric", "@attribute 'w_it\\'s' numeric", "@attribute x_sentiment {a,b}", "@data"]


def test_lines_are_dense_or_sparse(spark):
    rows = spark.createDataFrame([([1, 4], "a"), ([], "b"), ([0, 5], "c")], "features array<long>, k string")
    assert [r[0] for r in features.csv_rows(rows, 6, -1, ["k"]).collect()] == ["-1,1,-1,-1,1,-1,a", "-1,-1,-1,-1,-1,-1,b", "1,-1,-1,-1,-1,1,c"]
    assert [r[0] for r in features.csv_rows(rows, 6, 0, ["k"], True).collect()] == ["{1 1, 4 1, 6 a}", "{6 b}", "{0 1, 5 1, 6 c}"]
