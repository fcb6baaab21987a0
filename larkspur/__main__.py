"""Run a workflow file: python -m larkspur file.xml [--rerun-everything] [--table name=parquet] [--lexicon file]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .corpus import Corpus
from .plans import workflow
from .sources import corpora


def main(argv: list[str] | None = None) -> Corpus:
    args = argparse.ArgumentParser(prog="larkspur", description="Run a workflow.")
    args.add_argument("workflow", help="the XML file")
    args.add_argument("--rerun-everything", action="store_true", help="make the results of previous workflows anew")
    args.add_argument("--table", action="append", default=[], metavar="NAME=PATH", help="a Parquet table to start with")
    args.add_argument("--lexicon", help="a tab-separated lexicon file, for the table lexicon")
    args.add_argument("--validate", action="store_true", help="check the file only")
    given = args.parse_args(argv)
    spark = SparkSession.builder.appName("larkspur").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    text = workflow.read_text(spark, given.workflow)
    w = workflow.parse(text)
    workflow.validate(w)
    own = {name: spark.read.parquet(path) for name, _, path in (t.partition("=") for t in given.table)}
    if given.lexicon:
        own["lexicon"] = corpora.senti_word_net(spark, given.lexicon)
    if given.validate:
        return Corpus(spark, own)
    return workflow.run(spark, w, None, None, None, given.rerun_everything, given.workflow, own)


if __name__ == "__main__":
    main()
