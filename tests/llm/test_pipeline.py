"""The pipeline's stages on a small corpus with planted cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm.queries import queries


def corpus(tmp_path, spark):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{int(rng.random() ** 2 * 2000)}" for _ in range(n))
    docs, labels = [], []
    for i in range(400):
        docs.append((i, text(rng.randrange(30, 90))))
        labels.append((i, 1, 0))
    for i in range(400, 460):
        docs.append((i, text(40) + " idiot scum moron " + text(10)))
        labels.append((i, 1, 1))
    for i in range(460, 500):
        docs.append((i, " ".join(f"{text(1)} | §{rng.randrange(10**9)}" for _ in range(40))))
        labels.append((i, 0, 0))
    docs += [(500, docs[3][1]), (501, docs[3][1] + " tail"), (502, None), (503, ""), (504, "too short"), (505, docs[450][1])]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, tmp_path):
    d = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.save(stage(spark, docs, d), "stage")
        assert docs.columns == corpus_pipeline.COLUMNS
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    toxic, quality, near = kept
    assert not toxic & set(range(400, 460)) and len(toxic & set(range(400))) >= 398 and 505 not in toxic
    assert not quality & {502, 503, 504} and len(quality & set(range(460, 500))) <= 2 and len(quality & set(range(400))) >= 396
    assert 3 in near and not near & {500, 501}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert {r["doc_id"] for r in packed.collect()} == near
    assert corpus_pipeline.run(spark, d).count() == packed.count()


def test_rows_of_one_id_null_ids_and_repeats(spark):
    """Of texts A, B and C each stays once, whatever ids their rows have."""
    a, b, c, d = ("a b c d e f g h", "q r s t u v w x", "k l m n o p q r", "one two three four five six")
    rows = [(3, a), (5, a), (5, b), (5, b), (None, c), (None, a), (9, d), (None, d), (7, None), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("_key", F.lit("x")).withColumn("first", F.lit("y"))
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(3, a), (5, b), (None, c), (9, d), (7, None), (8, "")], key=str)
    assert corpus_pipeline.drop_near_duplicates(spark, docs, "").columns == corpus_pipeline.COLUMNS


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries()} == set(range(1, 14))
