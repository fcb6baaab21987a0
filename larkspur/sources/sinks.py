"""Sinks: tables, delimited results, text exports, manifests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..corpus import Corpus
from ..registry import Spec, operator


def write_text(path: str, header: DataFrame | None, rows: DataFrame) -> None:
    """A folder with the header (place, value) in order of its part files, and the rows beside it."""
    rows.write.mode("overwrite").text(f"{path}/rows")
    if header is not None:
        header.orderBy("place").select("value").write.mode("overwrite").text(f"{path}/header")


def quoted_lines(rows: DataFrame, label: str, text: str) -> DataFrame:
    """value: label and quoted text of each row; quotes in it go and line ends become blanks."""
    plain = F.replace(F.replace(F.col(text), F.lit('"'), F.lit("")), F.lit("\n"), F.lit(" "))
    return rows.select(F.concat(F.col(label), F.lit(', "'), plain, F.lit('" ')).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def retain(corpus: Corpus, path: str) -> None:
    """Every table as Parquet in a folder of this run, then a manifest with the metadata, which makes the run the one to read."""
    spark, run = corpus.spark, uuid.uuid4().hex
    for name, df in corpus.tables.items():
        df.write.parquet(f"{path}/{run}/{name}")
    fs, at = _files(spark, f"{path}/manifest.json")
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(json.dumps({"run": run, "tables": sorted(corpus.tables), "metadata": corpus.metadata}).encode()))
    finally:
        stream.close()


def retained(spark: SparkSession, path: str) -> Corpus | None:
    """What ``retain`` has written to path last; None if nothing."""
    fs, at = _files(spark, f"{path}/manifest.json")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        m = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Corpus(spark, {t: spark.read.parquet(f"{path}/{m['run']}/{t}") for t in m["tables"]}, m["metadata"])


def attribute_lines(features: DataFrame) -> DataFrame:
    """value: label and attributes of each position, tab-separated, with colons and backslashes escaped.

    features: (identifier, at, label, features: array<string>).
    """
    escaped = F.transform("features", lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:")))
    return features.select("identifier", "at", F.concat_ws("\t", "label", F.array_join(escaped, "\t")).alias("value"))


@operator("WekaBenchmarkExport", ("name",))
def _benchmark(c: Corpus, s: Spec) -> Corpus:
    write_csv(c.table("results"), s.get("name"))
    return c


@operator("WekaResultsExport", ("file", "table"))
def _results(c: Corpus, s: Spec) -> Corpus:
    rows = c.table(f"classification_{s.get('table')}").select("identifier", "positive", "negative")
    write_csv(rows.toDF("Document ID", "Positive Confidence", "Negative Confidence"), s.get("file"))
    return c


@operator("CRFSubjectiveExporter", ("path",))
def _crf(c: Corpus, s: Spec) -> Corpus:
    from ..operators.phrases import context_features, labelled_words, share_vectors

    marks = c.dependent("subphrases").select(F.col("document_identifier").alias("identifier"), "annotation")
    rows = labelled_words(c.input, share_vectors(marks)).select("identifier", "at", F.col("class").cast("string").alias("label"))
    lines = attribute_lines(context_features(c.input).join(rows, ["identifier", "at"]))
    lines.repartition("identifier").sortWithinPartitions("identifier", "at").select("value").write.mode("overwrite").text(s.get("path"))
    return c
