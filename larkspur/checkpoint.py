"""Tables in the shared folder, and results of workflows kept under a fingerprint."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .corpus import Corpus


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; our own only where it is unset and the session is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read again, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/larkspur-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._durable_at = path
    return out


def delete(df: DataFrame) -> None:
    """Delete a table that ``durable`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._durable_at)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch():
    """keep(durable table) gives the table back; all that were kept are deleted at the end, whether it fails or not."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        for df in kept:
            delete(df)


def fingerprint(text: str, inputs: dict[str, str] | None = None) -> str:
    return hashlib.sha256(json.dumps([text, sorted((inputs or {}).items())]).encode()).hexdigest()[:32]


class ResultStore:
    """Corpora kept by fingerprint: a table a folder, and a manifest written last."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def find(self, key: str) -> Corpus | None:
        at = self._path(f"{self.root}/{key}/manifest.json")
        fs = at.getFileSystem(self.conf)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            m = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Corpus(self.spark, {t: self.spark.read.parquet(f"{self.root}/{key}/{m['run']}/{t}") for t in m["tables"]}, m["metadata"])

    def keep(self, key: str, corpus: Corpus) -> Corpus:
        run = uuid.uuid4().hex
        for name, df in corpus.tables.items():
            df.write.parquet(f"{self.root}/{key}/{run}/{name}")
        at = self._path(f"{self.root}/{key}/manifest.json")
        stream = at.getFileSystem(self.conf).create(at, True)
        try:
            stream.write(bytearray(json.dumps({"run": run, "tables": sorted(corpus.tables), "metadata": corpus.metadata}).encode()))
        finally:
            stream.close()
        return self.find(key)
