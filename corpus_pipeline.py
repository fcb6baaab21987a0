"""The corpus pipeline: toxicity, quality rules, near duplicates, packing.

Each stage works on all that the one before kept.  A stage's result is written as Parquet
to the shared folder and read again as the next one's documents; all but the last
return the columns of documents, and a result is deleted once the next one is written.
Null and empty texts count as texts without words: they pass the toxicity stage if the bias
does, and fail the quality rules.  Rows of one doc_id with different texts are documents each;
equal rows are copies, of which one stays; a null doc_id is taken as the greatest.  Further columns
are left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common
from larkspur.llm.common import discard, save
from larkspur.llm.jaccard_join import jaccard_classes
from larkspur.llm.packing import pack_documents
from larkspur.llm.quality import quality_rules
from larkspur.llm.queries import vocabulary_path
from larkspur.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs.select(COLUMNS), labels).where("predicted = 0").select(COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return quality_rules(docs.select(COLUMNS), trusted).where("kept").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links join the document with the smallest id, once.

    Rows are told apart by id and text.  Those to drop are few next to the texts, so they are looked up in
    a broadcast where their number is small; one of several equal rows is chosen among such rows alone.
    """
    rows = docs.select(*COLUMNS, F.coalesce("doc_id", F.lit(2**63 - 1)).alias("_id"), F.xxhash64("text").alias("_key"))
    classes = jaccard_classes(rows, "_id", key_col="_key").groupBy("_id", "_key").agg(F.bool_or("first").alias("first"), F.count("*").alias("n"))
    odd = save(classes.where("NOT first OR n > 1").select("_id", "_key", "first"), "odd")
    found = rows.join(F.broadcast(odd) if odd.count() <= common.SMALL else odd, ["_id", "_key"], "left")
    once = found.where("first").dropDuplicates(["_id", "_key"])
    return found.where("first IS NULL").unionByName(once).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return pack_documents(docs, vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("best_fit_packing", pack),
]

#: The hashed model, the components and the packing are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        done, docs = docs, save(stage(spark, docs, sf_dir), name)
        if k:
            discard(done)
    return docs
