"""Readers, workflows, kept results, streams, entry points."""

import json
import lzma
import sqlite3

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from larkspur.__main__ import main as command
from larkspur.checkpoint import ResultStore
from larkspur.corpus import Corpus
from larkspur.operators import results
from larkspur.plans import workflow
from larkspur.registry import OPERATORS, Spec, as_bool
from larkspur.sources import corpora, sinks
from larkspur.streaming import ingest


def test_delimited_corpora(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text('topic,label,c,d,text\nt,positive,,,"good, ""fine""\nday"\nt,other,,,plain\nt,positive,,,plain\n')
    rows = corpora.sanders(spark, str(tmp_path))
    got = sorted((r["identifier"], r["document"], r["label"]) for r in rows.collect())
    assert got == [(1, 'good, "fine"\nday', "positive"), (2, "plain", "other"), (3, "plain", "positive")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.tsv").write_text("l\tb\tc\ttext\npos\t\t\thello\n")
    assert [(r["document"], r["label"]) for r in corpora.sascha(spark, str(tmp_path / "t")).collect()] == [("hello", "pos")]


def test_votes(spark, tmp_path):
    (tmp_path / "v.csv").write_text("text,a,b,c,d,e\nyes,1,1,1,0,2\nno,1,1,0,0,2\nlow,-2,-2,-2,0,0\n")
    assert sorted((r["document"], r["label"]) for r in corpora.own_corpus(spark, str(tmp_path / "v.csv")).collect()) == [("low", "-2"), ("yes", "1")]


def test_painted_spans(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("1\t9\t0\t1\tpositive\ta b c\n1\t9\t2\t2\tnegative\ta b c\n2\t8\t0\t0\tneutral\tNot Available\n3\t7\t1\t5\tneutral\tx\ty z\n")
    got = {r["sid"]: (r["text"], r["annotation"]) for r in corpora.paint(corpora.semeval_spans(spark, str(tmp_path / "s.tsv"))).collect()}
    assert got == {"9": ("a b c", "ppn"), "7": ("x\ty z", "qe")}


def test_crowd_work(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Input.tweet,Answer.subphrases,Answer.sentiment,AssignmentStatus\nhi you,p|q,positive,Approved\nhi you,q|q,neutral,Approved\nno,p,positive,Rejected\n")
    c = corpora.crowd_corpus(spark, corpora.crowd_work(spark, str(tmp_path)))
    assert c.input.count() == 1 and c.table("subphrases").count() == 2
    assert sorted(r["annotation"] for r in c.table("subphrases").collect()) == ["pq", "qq"]
    assert {r["label"] for r in c.table("label_names_sentiment").collect()} == {"positive", "neutral"}


def test_tweet_archives(spark, tmp_path):
    for name, kind in (("a", "TWEET_TEXT"), ("b", "OTHER")):
        con = sqlite3.connect(tmp_path / f"{name}.db")
        con.executescript(f"CREATE TABLE metadata(key, value); INSERT INTO metadata VALUES ('data_format', '{kind}'); CREATE TABLE stream(identifier, date, response); INSERT INTO stream VALUES (1, '2012-01-02 03:04:05', 'hello {name}');")
        con.commit()
        con.close()
        (tmp_path / f"{name}.xz").write_bytes(lzma.compress((tmp_path / f"{name}.db").read_bytes()))
    assert [(r["document"], str(r["date"])) for r in corpora.tweet_archives(spark, str(tmp_path)).collect()] == [("hello a", "2012-01-02 03:04:05")]


def test_small_readers(spark, tmp_path):
    (tmp_path / "m.txt").write_text("type=weaksubj len=1 word1=good\ntype=strongsubj len=1 word1=good priorpolarity=negative\n")
    assert [tuple(r) for r in corpora.subjectivity_clues(spark, str(tmp_path / "m.txt")).collect()] == [("good", "strongsubj", "negative", -1, 0)]
    (tmp_path / "c.txt").write_text("a DT 0\nb NN 1\n\nc VB 0\n")
    assert sorted(len(r["items"]) for r in corpora.sequences(spark, str(tmp_path / "c.txt")).collect()) == [1, 2]
    (tmp_path / "p.csv").write_text("word,1\nother,2\n")
    assert sorted(r[0] for r in corpora.pivots(spark, str(tmp_path / "p.csv")).collect()) == ["other_pivot", "word_pivot"]
    feed = "<rss><channel><item><title>T</title><description>First. Second.</description></item></channel></rss>"
    assert [tuple(r) for r in corpora.feed_items(spark.createDataFrame([("s", feed)], "source string, xml string")).collect()] == [("s", "T", "First")]


XML = """<Workflow><WorkflowOptions><WorkflowName>n</WorkflowName></WorkflowOptions><!-- c -->
<WorkflowTasks><BasicFilter filterText="http"/><UniqueFilter/><EmoticonLabeller dest="e"/><HasNoLabelFilter src="e"/></WorkflowTasks></Workflow>"""


def start(spark):
    rows = [(1, "a :)"), (2, "b http://x :)"), (3, "c"), (4, "d :("), (5, "e"), (6, "e")]
    return Corpus(spark, {"input": spark.createDataFrame(rows, "identifier long, document string")})


def test_workflow(spark):
    done = workflow.run(spark, workflow.parse(XML), start(spark))
    assert sorted(r["identifier"] for r in done.input.collect()) == [1, 4]
    assert done.metadata["WORKFLOW_NAME"] == "n"


def test_unknown_tags_and_missing_attributes_fail_before_running(spark):
    with pytest.raises(ValueError, match="no operator"):
        workflow.run(spark, workflow.parse("<W><WorkflowTasks><Nope/></WorkflowTasks></W>"))
    with pytest.raises(ValueError, match="lacks filterText"):
        workflow.run(spark, workflow.parse("<W><WorkflowTasks><BasicFilter/></WorkflowTasks></W>"))
    with pytest.raises(ValueError):
        as_bool("maybe")


def test_previous_workflows_are_kept_by_content(spark, tmp_path):
    store = ResultStore(spark, f"file://{tmp_path}/kept")
    ran = []

    def load(name):
        ran.append(name)
        return (tmp_path / name).read_text()

    (tmp_path / "t.csv").write_text("topic,label,c,d,text\nt,positive,,,hello\n")
    (tmp_path / "one.xml").write_text(f'<W><InputSources><SandersInputSource dir="{tmp_path}/t.csv"/></InputSources></W>')
    two = workflow.parse('<W><InputSources><PreviousWorkflow path="one.xml"/></InputSources></W>')
    for _ in range(2):
        assert workflow.run(spark, two, store=store, load=load).input.count() == 1
    assert len(list((tmp_path / "kept").iterdir())) == 1 and ran == ["one.xml", "one.xml"]


def test_sinks(spark, tmp_path):
    sinks.retain(start(spark), str(tmp_path / "out"))
    assert sinks.retained(spark, str(tmp_path / "out")).input.count() == 6 and sinks.retained(spark, str(tmp_path / "no")) is None
    rows = spark.createDataFrame([(1, 0, "L", ["w[0]=a:b", "x\\"])], "identifier long, at int, label string, features array<string>")
    assert sinks.attribute_lines(rows).first()["value"] == "L\tw[0]=a\\:b\tx\\\\"


def test_feature_export(spark, tmp_path):
    c = start(spark).with_table("subphrases", spark.createDataFrame([(1, 1, "pp", "positive"), (2, 3, "q", "neutral")], "identifier long, document_identifier long, annotation string, sentiment string"))
    steps = workflow.steps(("UnigramBinaryPresenceWithPercentageSubjectiveARFFExporter", {"path": str(tmp_path / "f"), "threshold": 1}))
    workflow.run(spark, workflow.Workflow(tasks=steps), c)
    header = [r[0] for r in spark.read.text(str(tmp_path / "f/header")).collect()]
    assert header[0] == "@relation corpus" and "@attribute w_a numeric" in header
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "f/rows")).collect())
    assert len(lines) == 2 and all(len(x.split(",")) == len(header) - 2 for x in lines)


def test_cross_domain_export_has_rows_of_one_domain(spark, tmp_path):
    docs = spark.createDataFrame([(1, "apple good"), (2, "pear bad"), (3, "apple fine")], "identifier long, document string")
    sub = spark.createDataFrame([(k, k, "qp", "positive") for k in (1, 2, 3)], "identifier long, document_identifier long, annotation string, sentiment string")
    c = Corpus(spark, {"input": docs, "subphrases": sub})
    c = c.with_table("label_domains", spark.createDataFrame([(1, 0), (2, 1), (3, 0), (3, 1)], "document_identifier long, label long"))
    c = c.with_table("label_names_domains", spark.createDataFrame([(0, "fruit"), (1, "tree")], "label_identifier long, label string"))
    step = ("CrossDomainUnigramDataExporter", {"path": str(tmp_path / "f"), "domain": "fruit", "threshold": 1})
    workflow.run(spark, workflow.Workflow(tasks=workflow.steps(step)), c)
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "f/rows")).collect())
    # apple bad fine good pear: the vocabulary is that of all domains
    assert [x.split(",")[:5] for x in lines] == [["1", "0", "0", "1", "0"], ["1", "0", "1", "0", "0"]]


def test_wide_crowd_work(spark, tmp_path):
    names = ["Input.tweet", "Input.tweet2"] + [f"Answer.{n}{p}" for p in ("", "second") for n in ("phrase1begin", "phrase1end", "sentimentphrase1", "phrase2begin", "phrase2end", "phrase3end", "phrase4end", "sentimentphrase2", "sentimentphrase3", "sentimentphrase4")]
    rows = [["a b c d e f", "x y z", "1", "2", "pos", "3|5", "3", "6", "", "neg", "neu", "", "2", "2", "neu", "", "", "", "", "", "", ""], ["q", "r s", "", "", "", "1", "1", "", "", "pos", "", "", "1", "2", "neg", "1|2", "", "", "", "", "", ""]]
    (tmp_path / "h.csv").write_text("\n".join(",".join(r) for r in [names, *rows]) + "\n")
    got = sorted(tuple(r) for r in corpora.hit_phrases(spark, str(tmp_path / "h.csv")).collect())
    assert got == [("a b c d e f", 1, "a b", "pos"), ("a b c d e f", 2, "c", "neg"), ("a b c d e f", 3, "e f", "neu"), ("r s", 1, "r s", "neg"), ("x y z", 1, "y", "neu")]


def lines(spark, path):
    return sorted(r[0] for r in spark.read.text(str(path)).collect())


def exported(spark, tmp_path, name, c, **attributes):
    workflow.run(spark, workflow.Workflow(tasks=workflow.steps((name, {"path": str(tmp_path / name), **attributes}))), c)
    return lines(spark, tmp_path / name / "rows"), lines(spark, tmp_path / name / "header") if (tmp_path / name / "header").exists() else None


def labelled_corpus(spark):
    docs = spark.createDataFrame([(1, "apple good", "train"), (2, "pear bad", "train_semval"), (3, "apple fine", "test"), (4, "the pears", "train")], "identifier long, document string, source string")
    c = Corpus(spark, {"input": docs})
    c = corpora.associate(c, "sentiment", spark.createDataFrame([(1, "positive"), (4, "neutral")], "identifier long, label string"))
    return corpora.associate(c, "semval", spark.createDataFrame([(2, "negative"), (3, "positive")], "identifier long, label string"))


def test_sem_eval_exports(spark, tmp_path):
    c = labelled_corpus(spark)
    # words: apple bad fine good pear pears the
    rows, head = exported(spark, tmp_path, "SemEvalUnigramDataExporter", c, source="train")
    assert rows == sorted(["1,0,0,1,0,0,0,1", "0,1,0,0,1,0,0,-1", "0,0,0,0,0,1,1,0"])
    assert "@attribute x_sentiment_label {1,0,-1}" in head and len(head) == 10
    rows, _ = exported(spark, tmp_path / "t", "SemEvalUnigramDataExporter", c, source="test", useStopWords="true", stem="true")
    # appl bad fine good pear, without the
    assert rows == ["1,0,1,0,0,1"]
    rows, _ = exported(spark, tmp_path, "SemEvalBigramDataExporter", c, source="test", sparse="true")
    assert rows == ["{0 1, 4 1}"]


def test_pivot_export(spark, tmp_path):
    (tmp_path / "p.csv").write_text("good,1\npear,2\nnone,3\n")
    rows, head = exported(spark, tmp_path, "CrossDomainUnigramPivotDataExporter", labelled_corpus(spark), pivots=str(tmp_path / "p.csv"), test_domain="x")
    # seven words, then good_pivot, none_pivot, pear_pivot
    assert "1,-1,-1,1,-1,-1,-1,1,-1,-1" in rows and "-1,1,-1,-1,1,-1,-1,-1,-1,1" in rows and len(rows) == 3
    assert "@attribute x_none_pivot numeric" in head


def test_tagged_bigrams(spark, tmp_path):
    c = start(spark).with_table("subphrases", spark.createDataFrame([(1, 1, "pp", "positive")], "identifier long, document_identifier long, annotation string, sentiment string"))
    c = c.with_table("pos_gimpel", spark.createDataFrame([(1, 1, [7, 9, 7]), (2, 2, [9, 7])], "identifier long, document_identifier long, tokens array<long>"))
    rows, head = exported(spark, tmp_path, "BigramBinaryPresencePercentageSubjectiveGimpelTaggedARFFExporter", c)
    assert rows == ["1,1,1.0,0.0,0.0,positive"] and "@attribute 'w_7 9' numeric" in head


def test_cross_validation_of_unknown_children_is_refused(spark):
    with pytest.raises(ValueError):
        name = "SubjectiveCrossValidationEnvironment"
        OPERATORS[name].run(start(spark), Spec(name, {}, [Spec("UniqueFilter")]))


#: tags with all attributes that users' workflow files give them
USED = """AMTInputSource dir|AMTNormalise|AtMentionLabeller dest|BasicFilter filterText matchBefore matchAfter|BasicNotFilter filterText|BasicWordLabeller dest
BigramBinaryPresencePercentageSubjectiveARFFExporter path outputTable stem useStopWords|BigramLabeller dest|CRFSubjectivityTagger mode resultsPath modelPath
ClusterLabeller src dest epsilon minSize|CrossDomainUnigramDataExporter outputTable path domain|CrossDomainUnigramPivotDataExporter outputTable path pivots test_domain
DomainLabeller|EmoticonLabeller dest|EmpiricalSubjectivePhraseAnnotator outputTable|FinancialDistanceAnnotator pos annotateStockTweets|FixedSubjectivePhraseAnnotator outputTable
GimpelPOSTagger dest verbose|HashTagLabeller dest|LabelFilter src temporary delete|LengthLabeller dest binSize|LineBreakFilter|MatchSubjectiveAnnotations subphrases_table table src_table
NLTKSubjectivePhraseBayesianAnnotator outputTable|NLTKSubjectivePhraseMarkovAnnotator outputTable useSentiWordNet useMQPA normalisingRExp normaliseCase stemmer lemmatise|OurInputSource dir
PreviousWorkflow path|ProbablySpamUnicodeLabeller dest|ProduceCRFSTagList test_path train_path|PythonClassifiers posSrc labelSrc folds classifier|ResultPivotTableOutput bucket
RewritePOSFilter src tag|SandersInputSource dir|SaschaInputSource dir|SemEvalTaskAImport key path|SemEvalUnigramDataExporter outputTable path source useStopWords|SemvalInputSource dir source create
SentiWordNetPositiveOrNegativeStrengthLabeller threshold dest|SentiWordNetPositiveStrengthLabeller threshold dest|SpecialCharacterLengthLabeller dest binSize|Stemmer dest verbose
SubjectiveAnnotationEvaluator bucket predictedTable sourceTable metric|SubjectiveCrossValidationEnvironment folds bucket|SubjectivePhraseARFFExporter path exportLevel outputTable
SubjectivePhraseTweetClassificationARFFExporter path outputTable|SubjectiveWordARFFExporter path normaliseCase stemmer normalisingRExp stopWords|SubjectivityAnnotator
TrainingTestSplitLabeller testProportion dest|TwitterInputSource dir|UnigramBinaryPresenceWithTotalNumberOfSubjectivePhrasesARFFExporter outputTable path|UniqueFilter|UniqueTextFilter
WekaBenchmark id posSrc labelSrc folds classifier path|WekaBenchmarkExport name|WekaClassify id posSrc labelSrc splitSrc dest classifier|WekaCrossDomainBenchmark id posSrc labelSrc folds classifier
WekaResultsExport file table|WhiteSpacePOSTagger dest|WordSenseDisambiguate table""".replace("\n", "|")


def test_attributes_of_users_workflows_are_known():
    for tag in USED.split("|"):
        name, *attributes = tag.split(" ")
        w = workflow.parse("<W><WorkflowTasks><%s %s/></WorkflowTasks></W>" % (name, " ".join(f'{a}="{"weka.classifiers.rules.JRip" if a == "classifier" else 1}"' for a in attributes)))
        workflow.validate(w)
    with pytest.raises(ValueError, match="knows no eps"):
        workflow.validate(workflow.parse('<W><WorkflowTasks><ClusterLabeller src="a" dest="b" eps="1"/></WorkflowTasks></W>'))


def test_annotate_evaluate_and_pivot(spark, tmp_path):
    """Crowd work, annotators by file, evaluators into a bucket, a pivot; run from a file by the command."""
    (tmp_path / "w").mkdir()
    for k, (text, marks) in enumerate((("Good day", "pq"), ("good bad day", "pnq"))):
        (tmp_path / "w" / f"b{k}.csv").write_text(f"Input.tweet,Answer.subphrases,Answer.sentiment,AssignmentStatus\n{text},{marks},positive,Approved\n{text},{marks},positive,Approved\n")
    flow = f"<DataFlow><Source>{tmp_path}/w/b0.csv</Source><Target>{tmp_path}/w/b1.csv</Target></DataFlow>"
    words = '<EntryNodes><Word string="good" prob="1.0"/></EntryNodes><ForwardTransitionNodes><Word string="good" prob="0.5"/></ForwardTransitionNodes>'
    evaluators = "".join(f'<SubjectiveAnnotationEvaluator bucket="b" sourceTable="empirical" predictedTable="{t}"/>' for t in ("fixed", "bayes"))
    (tmp_path / "flow.xml").write_text(
        f"""<Workflow><WorkflowOptions><WorkflowName>a</WorkflowName><RetainOutputFile path="{tmp_path}/kept"/><DebugDocumentCount path="{tmp_path}/counts"/></WorkflowOptions>
<InputSources><AMTInputSource dir="{tmp_path}/w"/></InputSources><WorkflowTasks><EmpiricalSubjectivePhraseAnnotator outputTable="empirical"/>
<FixedSubjectivePhraseAnnotator outputTable="fixed">{flow}{words}</FixedSubjectivePhraseAnnotator><NLTKSubjectivePhraseBayesianAnnotator outputTable="bayes">{flow}</NLTKSubjectivePhraseBayesianAnnotator>
{evaluators}<ResultPivotTableOutput bucket="b"><Target>error</Target><Row>prediction</Row><GroupOperation operation="sum"/></ResultPivotTableOutput></WorkflowTasks></Workflow>"""
    )
    made = command([str(tmp_path / "flow.xml")])
    c = sinks.retained(spark, str(tmp_path / "kept"))
    assert c.input.count() == 2 and c.table("subphrases").count() == 4 and c.metadata["WORKFLOW_NAME"] == "a" == made.metadata["WORKFLOW_NAME"]
    assert sorted({r["label"] for r in c.table("label_names_amt").collect()}) == [f"{tmp_path}/w/b0.csv", f"{tmp_path}/w/b1.csv"]
    two = c.input.where("document = 'good bad day'").first()["identifier"]
    assert [tuple(r) for r in c.table("subphrases_fixed").select("identifier", "annotation").collect()] == [(two, [1.0, 0.5, 0.0])]
    # good was not observed in b0 but as the text's first word: a whole share is class 9
    assert [r["annotation"] for r in c.table("subphrases_bayes").collect()] == [[0.9, 0.0, 0.0]]
    # observed 1 1 0; documents without a prediction don't count
    got = {r["prediction"]: r["sum_error"] for r in c.table("pivot_b").collect()}
    assert got["fixed"] == pytest.approx(0.25) and got["bayes"] == pytest.approx(0.01 + 1.0)
    assert spark.read.option("header", "true").csv(str(tmp_path / "counts")).count() == 7


def test_previous_output_is_read_or_made_again(spark, tmp_path):
    (tmp_path / "t.csv").write_text("topic,label,c,d,text\nt,positive,,,hello\nt,negative,,,worse\n")
    one = f'<W><WorkflowOptions><RetainOutputFile path="{tmp_path}/out"/></WorkflowOptions><InputSources><SandersInputSource dir="{tmp_path}/t.csv"/></InputSources></W>'
    (tmp_path / "one.xml").write_text(one)
    two = workflow.parse(f'<W><InputSources><PreviousWorkflow path="{tmp_path}/one.xml"/></InputSources><WorkflowTasks><HasLabelFilter src="none"/></WorkflowTasks></W>')
    first = workflow.run(spark, two)
    assert sorted(tuple(r) for r in first.labels("sanders").collect()) == [(1, 1), (2, -1)]
    runs = lambda: {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()}
    before = runs()
    workflow.run(spark, two)
    assert runs() == before
    (tmp_path / "one.xml").write_text(one.replace("<W>", "<W><!-- changed -->"))
    workflow.run(spark, two)
    assert len(runs()) == 2
    workflow.run(spark, two, rerun=True)
    assert len(runs()) == 3
    by_db = workflow.parse(f'<W><InputSources><PreviousWorkflow db="{tmp_path}/out"/></InputSources></W>')
    assert workflow.run(spark, by_db).input.count() == 2


def test_benchmarks_of_a_workflow(spark, tmp_path):
    rows = [(i, ("good w%d" if i % 2 else "bad w%d") % (i % 5), "en" if i % 3 else "fr") for i in range(60)]
    c = Corpus(spark, {"input": spark.createDataFrame(rows, "identifier long, document string, source string")})
    c = corpora.associate(c, "domains", spark.createDataFrame([(i, s) for i, _, s in rows], "identifier long, label string"))
    c = c.with_table("temporary_label_y", spark.createDataFrame([(i, 1 if i % 2 else -1) for i in range(60)], "document_identifier long, label long"))
    more = {"id": "1", "posSrc": "t", "labelSrc": "y", "folds": 2}
    steps = workflow.steps(
        ("WhiteSpacePOSTagger", {"dest": "t"}), ("WekaBenchmark", {**more, "classifier": "weka.classifiers.bayes.NaiveBayes"}), ("WekaCrossDomainBenchmark", {**more, "classifier": "weka.classifiers.lazy.IBk"}),
        ("PythonClassifiers", {"posSrc": "t", "labelSrc": "y", "folds": 2, "classifier": "tree.DecisionTreeClassifier()"}), ("TrainingTestSplitLabeller", {"dest": "split", "testProportion": 0.4}),
        ("WekaClassify", {"id": "1", "posSrc": "t", "labelSrc": "y", "splitSrc": "split", "dest": "d", "classifier": "NaiveBayes"}),
        ("WekaBenchmarkExport", {"name": str(tmp_path / "r")}), ("WekaResultsExport", {"table": "d", "file": str(tmp_path / "c")}),
    )
    c = workflow.run(spark, workflow.Workflow(tasks=steps), c)
    found = spark.read.option("header", "true").csv(str(tmp_path / "r"))
    assert found.columns == results.RESULT_COLUMNS and sorted((r["identifier"], r["train_domain"], r["test_domain"]) for r in found.collect()) == [("1", None, None), ("2", "en", "fr"), ("3", "fr", "en")]
    assert c.table("accuracies").first()["accuracy"] == 1.0
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).columns == ["Document ID", "Positive Confidence", "Negative Confidence"]


def test_moves_are_made_once(spark, tmp_path):
    """A batch that comes again, before or after its manifest, neither loses nor doubles rows."""
    target = str(tmp_path / "out")
    batch = lambda a, z: spark.createDataFrame([(i,) for i in range(a, z)], "identifier long")
    ingest.move(batch(0, 4), 0, target, 6)
    ingest.move(batch(0, 4), 0, target, 6)
    ingest.move(batch(4, 7), 1, target, 6)
    (tmp_path / "out-manifests" / "1").unlink()  # stopped after the move, before the manifest
    batch(0, 4).write.parquet(f"{target}-held/batch=0")  # whose rows are deleted after it
    ingest.move(batch(4, 7), 1, target, 6)
    ingest.move(batch(4, 7), 1, target, 6)
    ingest.move(batch(7, 8), 2, target, 6)
    assert sorted(r["identifier"] for r in spark.read.parquet(target).collect()) == list(range(7))
    assert spark.read.parquet(f"{target}-held").count() == 1


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps({"identifier": i, "document": f"Apple {i}", "lang": "en"}) for i in range(4)))
    args = (spark, str(source), "identifier long, document string, lang string", str(tmp_path / "out"), str(tmp_path / "cp"))
    ingest.drain(*args, least=6).awaitTermination()
    assert not (tmp_path / "out").exists()
    (source / "b.json").write_text("\n".join(json.dumps({"identifier": i, "document": "x", "lang": "en"}) for i in range(4, 8)))
    ingest.drain(*args, least=6).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8
    ingest.drain(*args, least=6).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8
    stream = spark.readStream.schema("identifier long, document string, lang string").json(str(source))
    ingest.append(ingest.capture(stream, ["Apple"]), str(tmp_path / "kept"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 4


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(OPERATORS) > 50
    assert entry.entry(spark).select(F.sum("n_docs")).first()[0] > 0
