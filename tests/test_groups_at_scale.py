"""Rows of a document meet in one group that is worked on by Arrow batches; no aggregate gathers them."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.functions import groups
from larkspur.operators import annotations as A
from larkspur.operators import features, phrases


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def given(spark):
    d = spark.createDataFrame([(1, "A b a  c"), (2, "x"), (3, "é Ω"), (None, "n"), (4, None), (5, "no marks"), (6, "Big cat Sat")], "identifier long, document string")
    a = spark.createDataFrame([(1, "pnpqpp"), (1, "nq^"), (1, None), (3, "ep"), (3, "pe"), (2, ""), (None, "p"), (None, "n"), (4, "p"), (9, "é"), (6, "nqp")], "identifier long, annotation string")
    return d, a


@pytest.mark.parametrize("size", [1, 100, 1 << 20])
@pytest.mark.parametrize("cut", [1, 2, 5])
def test_groups_stay_whole_over_batches(size, cut, monkeypatch):
    monkeypatch.setattr(groups, "BYTES", size)
    keys = [None, None, 1, 1, 1, 1, 1, 1, 2, 3, 3, 7]
    rows = pa.table({"k": pa.array(keys, pa.int64()), "v": [None, *map(str, range(1, 12))]}).combine_chunks().to_batches()[0]
    batches = [rows.slice(lo, cut) for lo in range(0, 12, cut)]
    got = []
    for table, first in groups.whole([rows.slice(0, 0), *batches], "k"):
        got += zip(table.column("k").combine_chunks().take(pa.array(first)).to_pylist(), groups.lists(table, first, "v").to_pylist(), strict=True)
    assert got == [(None, ["1"]), (1, ["2", "3", "4", "5", "6", "7"]), (2, ["8"]), (3, ["9", "10"]), (7, ["11"])]


def test_union_votes_gather_nothing(spark):
    made = A.union_votes(given(spark)[1])
    assert "collect_list" not in plan(made)
    got = {(r["identifier"], r["at"]): r["mark"] for r in made.collect()}
    assert got[None, 0] == "p" and got[9, 0] == "^" and got[1, 3] == "q" and len(got) == 6 + 2 + 1 + 1 + 1 + 3


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_shares_and_word_marks_gather_nothing(spark, limit, monkeypatch):
    monkeypatch.setattr(A, "CHARACTERS", limit)
    d, a = given(spark)
    assert "collect_list" not in plan(A.share_vectors(a)) and "collect_list" not in plan(features.word_shares(d, a))
    assert {r["identifier"]: r["annotation"] for r in A.share_vectors(a).collect()}[1] == [1.0, 0.5, 1.0, 0.0, 1.0, 1.0]
    assert len(features.word_shares(d, a).collect()) == 4 + 2 + 3


def test_word_rates_are_summed_before_they_are_rows(spark):
    d = spark.createDataFrame([(k, "a b a") for k in range(50)], "identifier long, document string").coalesce(1)
    a = spark.createDataFrame([(k, "pqq") for k in range(50)], "identifier long, annotation string").coalesce(1)
    assert "Generate" not in plan(phrases.word_rates(d, a))
    assert {r["word"]: r["rate"] for r in phrases.word_rates(d, a).collect()} == {"a": 0.5, "b": 0.0}


def test_classes_are_counted_beside_the_texts(spark):
    d, a = given(spark)
    rows = phrases.labelled_words(d, A.share_vectors(a))
    assert sorted(map(tuple, phrases.marked_words(d, a).collect())) == sorted(map(tuple, rows.collect()))
    counts = phrases.class_counts(d, a)
    assert "Join" not in plan(counts) and plan(counts).count("Exchange hash") == 1
    want = {(r["word"], r["class"]): r["count"] for r in rows.groupBy("word", "class").count().collect()}
    assert {(r["word"], r["class"]): r["n"] for r in counts.groupBy("word", "class").agg(F.sum("n").alias("n")).collect()} == want and len(want) > 3
    assert sorted(map(tuple, phrases.bayes_table(counts).collect())) == sorted(map(tuple, phrases.bayes_table(rows).collect()))


def test_words_are_cleaned_in_their_bytes():
    words = ["", "Big", "on-IT", "9", "é", "Élan", "Kİn", "aßB", "İx", "zz", "ÀÉ", "a\tb", "[x]{Y}"]
    for names in (pa.array(words), pa.array(["gone", *words])[1:], pa.array(words[:2]), pa.array([], pa.string())):
        clean, low = phrases._cleaned(names)
        assert clean.to_pylist() == [phrases._clean(w) for w in names.to_pylist()]
        assert low.tolist() == [w[:1].lower() == w[:1] for w in names.to_pylist()]


ODD = ["The a-b caT\tdog", "", None, "  two  the  two ", "É x̂ İI ß", "only", "don't STOP, the Stop running runs", " ", "a\nb c", "x"]


@pytest.mark.parametrize("limit", [1, 1 << 20])
@pytest.mark.parametrize("options", [features.Options(1), features.Options(1, stop_words=True), features.Options(2, 0), features.Options(2, 1), features.Options(2, 1, stem=True, stop_words=True)])
def test_grams_of_bytes_are_those_of_the_columns(spark, options, limit, monkeypatch):
    monkeypatch.setattr(features, "TEXTS", limit)
    d = spark.createDataFrame(list(enumerate(ODD)), "identifier long, document string")
    want = [r["raw"] or [] for r in features.gram_lists(d, options).orderBy("identifier").collect()]
    got = []
    for piece in features._pieces(pa.array(["gone", *ODD], pa.string())[1:]):
        row, code, names = features._coded_grams(piece, options)
        got += [[names[int(c)].as_py() for c in code[row == k]] for k in range(len(piece))]
    assert got == want
    sums = features.gram_sums(d, options)
    assert "Generate" not in plan(sums)
    assert {r["raw"]: r["n"] for r in sums.collect()} == {w: sum(x.count(w) for x in want) for w in np.unique(sum(want, [])).tolist()}


def test_lines_meet_their_features_in_one_group(spark):
    rows = spark.createDataFrame([(1, 2, "p"), (1, 3, None), (2, 0, "n"), (3, 5, "e"), (None, 7, "p")], "identifier long, num long, sentiment string")
    parts = spark.createDataFrame([(1, [4, 9]), (1, [2, 4]), (3, []), (8, [1]), (None, [5])], "identifier long, features array<bigint>")
    made = features._beside_features(rows, parts, True)
    assert "Join" not in plan(made) and plan(made).count("Exchange hash") == 1
    assert sorted(r[0] for r in features.csv_rows(made, 10, 0, ["num", "sentiment"], True).collect()) == sorted(
        ["{2 1, 4 1, 9 1, 10 2, 11 p}", "{2 1, 4 1, 9 1, 10 3}", "{10 0, 11 n}", "{10 5, 11 e}", "{10 7, 11 p}"]
    )
    dense = features._beside_features(rows, parts, False)
    assert sorted((r["num"], r["features"]) for r in dense.collect()) == [(0, []), (2, [2, 4, 9]), (3, [2, 4, 9]), (5, []), (7, [])]


@pytest.mark.parametrize("kind", ["none", "number", "total", "percent"])
def test_statistics_are_made_before_the_join(spark, kind):
    from larkspur.corpus import Corpus

    d, a = given(spark)
    sub = a.where("annotation IS NOT NULL").select(F.col("identifier").alias("document_identifier"), "annotation", F.lit("positive").alias("sentiment"))
    c = Corpus(spark, {"input": d, "subphrases": sub})
    both = d.join(sub.withColumnRenamed("document_identifier", "identifier"), "identifier")
    extra = features._STATISTICS[kind]
    want = sorted(map(repr, (tuple(r) for r in features.statistics(both, "annotation", kind).select("identifier", *extra, "sentiment").collect())))
    made = features.annotated(c, kind)
    assert "annotation" not in made.columns and "document" not in made.columns
    assert sorted(map(repr, (tuple(r) for r in made.select("identifier", *extra, "sentiment").collect()))) == want
