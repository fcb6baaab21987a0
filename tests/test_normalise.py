"""Stemming, folding, normalised words, remaining exports."""

import pytest
from pyspark.sql import functions as F

from larkspur.corpus import Corpus
from larkspur.operators import annotations as A
from larkspur.operators import features, normalise, phrases
from larkspur.plans import workflow


def test_porter_on_published_examples():
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopeful": "hope", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll"}
    assert {w: normalise.porter(w) for w in want} == want


def test_folding():
    assert normalise.ascii_fold("Éﬁ x²日") == "Efi x2"


def test_normalised_words(spark):
    d = spark.createDataFrame([(1, "The Ponies !!! running")], "identifier long, document string")
    got = [r["word"] for r in normalise.normalised_words(d, normalise.Normaliser(True, "porter", True, "[^a-z]")).orderBy("at").collect()]
    assert got == ["STOPPED", "poni", "FILTERED", "run"]
    lemmas = spark.createDataFrame([("poni", "horse")], "word string, lemma string")
    got = [r["word"] for r in normalise.normalised_words(d, normalise.Normaliser(False, "porter"), lemmas).orderBy("at").collect()]
    assert got == ["the", "horse", "!!!", "run"]


def corpus(spark):
    docs = spark.createDataFrame([(1, "good day all"), (2, "bad day")], "identifier long, document string")
    sub = spark.createDataFrame([(1, 1, "ppq", "positive"), (2, 1, "pqq", "positive"), (3, 2, "nq", "negative")], "identifier long, document_identifier long, annotation string, sentiment string")
    return Corpus(spark, {"input": docs, "subphrases": sub})


def test_long_exports(spark, tmp_path):
    c = corpus(spark)
    for name in features.LONG_EXPORTERS:
        workflow.run(spark, workflow.Workflow(tasks=workflow.steps((name, {"path": str(tmp_path / name)}))), c)
        head = spark.read.text(str(tmp_path / name / "header")).collect()
        assert spark.read.text(str(tmp_path / name / "rows")).count() > 0 and head[0][0] == "@relation corpus" and head[-1][0] == "@data"


def test_annotators_of_a_workflow(spark, tmp_path):
    (tmp_path / "train").write_text("good DT 5\nday NN 0\n\nbad VB 9\n")
    (tmp_path / "test").write_text("good DT 0\nday NN 0\n")
    evaluate = ("SubjectiveAnnotationEvaluator", {"sourceTable": "subphrases", "predictedTable": "SubjectiveEvolution", "bucket": "b"})
    pivot = ("ResultPivotTableOutput", {"bucket": "b"}, [("Target", {"text": "error"}), ("Row", {"text": "prediction"})])
    names = ("SubjectiveEvolution", "NLTKSubjectivePhraseBayesianAnnotator", "EmpiricalSubjectivePhraseAnnotator", "HumanBasedSubjectivePhraseAnnotator")
    steps = workflow.steps(*((n, {"outputTable": n}) for n in names), ("ProduceCRFSTagList", {"train_path": str(tmp_path / "train"), "test_path": str(tmp_path / "test")}), evaluate, pivot)
    done = workflow.run(spark, workflow.Workflow(tasks=steps), corpus(spark))
    assert {len(r["annotation"]) for r in done.table("subphrases_SubjectiveEvolution").collect()} == {3, 2}
    assert [len(r["annotation"]) for r in done.table("tag_list").collect()] == [2]
    assert done.table("pivot_b").count() == 1


def test_modes_of_the_sequence_tagger(spark, tmp_path):
    c = corpus(spark)
    steps = workflow.steps(("CRFSubjectivityTagger", {"mode": "train", "modelPath": str(tmp_path / "m")}), ("CRFSubjectivityTagger", {"mode": "tag", "modelPath": str(tmp_path / "m"), "subphraseDest": "x"}), ("CRFSubjectivityTagger", {"mode": "evaluate", "resultsPath": str(tmp_path / "r")}))
    done = workflow.run(spark, workflow.Workflow(tasks=steps), c)
    assert {len(r["annotation"]) for r in done.table("subphrases_x").collect()} == {3, 2}
    assert (tmp_path / "r").exists()


def test_cross_validation_of_several_annotators(spark):
    rows = [(i, "good day here" if i % 2 else "bad day there") for i in range(20)]
    sub = spark.createDataFrame([(i, i, "pqq" if i % 2 else "nqq", "positive") for i in range(20)], "identifier long, document_identifier long, annotation string, sentiment string")
    c = Corpus(spark, {"input": spark.createDataFrame(rows, "identifier long, document string"), "subphrases": sub})
    words = [("EntryNodes", {}, [("Word", {"string": "good", "prob": "1.0"}), ("Word", {"string": "bad", "prob": "1.0"})])]
    children = [("FixedSubjectivePhraseAnnotator", {}, words), ("NLTKSubjectivePhraseBayesianAnnotator", {}), ("NLTKSubjectivePhraseMarkovAnnotator", {}), ("SubjectiveEvolution", {"generations": "1"})]
    done = workflow.run(spark, workflow.Workflow(tasks=workflow.steps(("SubjectiveCrossValidationEnvironment", {"folds": "2", "bucket": "b"}, children))), c)
    found = {(r["prediction"], r["fold"]): r["error"] for r in done.table("bucket_b").collect()}
    assert len(found) == 8 and all(found["FixedSubjectivePhraseAnnotator", k] == 0 for k in (0, 1))
    assert all(0 < found["NLTKSubjectivePhraseBayesianAnnotator", k] < 1 for k in (0, 1))


def test_evolution_scores_every_word_and_pair(spark, monkeypatch):
    rows = [(1, "The running dog #Tag @me !!"), (2, "dog bites"), (3, "one")]
    df = spark.createDataFrame(rows, "identifier long, document string")
    assert df.select(normalise.evolution_words(F.col("document"))).first()[0] == ["STOPPED_WORD", "run", "dog", "#tag", "AT", "FILTERED_WORD"]
    marks = spark.createDataFrame([(1, "qppqqq"), (2, "qn"), (3, "p")], "identifier long, annotation string")
    first = {r["key"]: (r["n"], r["score"]) for r in phrases.evolve(df, marks, 0).collect()}
    assert first["dog"] == (3, pytest.approx((0.9 + 0.9 + 0.0) / 3)) and first["dog bite"] == (1, pytest.approx(0.45)) and len(first) == 13
    observed = phrases.evolution_targets(phrases.evolution_pairs(df), A.subjectivity_vector(marks)).select("identifier", "at", ((F.col("a1") + F.col("a2")) / 2).alias("t"))

    def error(scores):
        made = phrases.evolved(df, scores).select("identifier", F.posexplode("annotation").alias("at", "p"))
        return made.join(observed, ["identifier", "at"]).agg(F.sum(F.pow(F.col("p") - F.col("t"), F.lit(2.0)))).first()[0]

    before, after = (error(phrases.evolve(df, marks, n, spread=0.0, seed=4)) for n in (0, 12))
    assert after < before
    monkeypatch.setattr(phrases, "FEW_KEYS", 0)
    assert error(phrases.evolve(df, marks, 12, spread=0.0, seed=4)) == pytest.approx(after)
    assert {r["identifier"]: len(r["annotation"]) for r in phrases.evolved(df, phrases.evolve(df, marks, 0)).collect()} == {1: 6, 2: 2, 3: 1}
