"""Acceptance rules for crowd work: the first rule that fails is the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = ("missing", "blacklisted", "too_positive", "too_negative", "too_neutral", "whole_tweet", "copied", "long_negative", "long_positive", "long_neutral")
LIMITS = {"p": 35, "n": 72, "e": 31}  # percent of the words
FEW = 5  # words up to which shares aren't looked at, and characters up to which runs aren't


def _count(annotation: Column, mark: str) -> Column:
    return F.length(annotation) - F.length(F.replace(annotation, F.lit(mark), F.lit("")))


def _first_run(annotation: Column, mark: str) -> Column:
    """Length of the first run of two or more."""
    return F.length(F.regexp_extract(annotation, f"({mark}{mark}+)", 1))


def verify(df: DataFrame, blacklist: list[str] = ()) -> DataFrame:
    """df (text, annotation, worker) with reason, the name of the first failing rule, null if the work is fine, and accepted.

    Shares are of the text's words, and count with over ``FEW`` words.  A whole tweet is one mark as often as there
    are words.  Copied is an annotation with a token of two or more characters among the text's
    space-split words.  Of runs only the first counts; it is held against the number of characters of texts
    of over ``FEW``.
    """
    text, annotation = F.col("text"), F.col("annotation")
    # what rules share is a column of its own, so that it is worked out once
    facts = {
        "_n": F.size(F.filter(F.split(text, r"[ \t\n\x0b\f\r]+"), lambda w: w != "")),
        "_length": F.length(text),
        "_copied": F.when(annotation.contains(" "), F.arrays_overlap(F.filter(F.split(annotation, " "), lambda t: F.length(t) >= 2), F.split(text, " "))).otherwise((F.length(annotation) >= 2) & F.array_contains(F.split(text, " "), annotation)),
        **{f"_count_{m}": _count(annotation, m) for m in "pne"},
        **{f"_run_{m}": _first_run(annotation, m) for m in "pne"},
    }
    share = lambda mark: (F.col("_n") > FEW) & (100.0 * F.col(f"_count_{mark}") > F.col("_n") * LIMITS[mark])
    run = lambda mark, part: (F.col("_length") > FEW) & (F.col(f"_run_{mark}") > 0) & (F.col(f"_run_{mark}") >= part * F.col("_length"))
    rules = [
        annotation.isNull() | (annotation == ""),
        F.col("worker").isin(list(blacklist)) if blacklist else F.lit(False),
        share("p"),
        share("n"),
        share("e"),
        F.greatest(*(F.col(f"_count_{m}") for m in "pne")) >= F.col("_n"),
        F.col("_copied"),
        run("n", 0.55),
        run("p", 0.4),
        run("e", 0.3),
    ]
    out = df.withColumns(facts).withColumn("reason", F.coalesce(*(F.when(r, F.lit(name)) for name, r in zip(RULES, rules, strict=True))))
    return out.withColumn("accepted", F.col("reason").isNull()).drop(*facts)


def four_row_statistics(df: DataFrame, order: str = "row") -> DataFrame:
    """group, entropy, mean_time (integer division), root_sum_square of each four rows; a partial group goes.

    df: (row from 0 without gaps, sentiment, seconds).
    """
    rows = df.withColumn("group", F.floor(F.col(order) / 4))
    counts = rows.groupBy("group", "sentiment").agg(F.count("*").alias("n"))
    entropy = counts.groupBy("group").agg(F.sum("n").alias("rows"), (-F.sum(F.col("n") / 4.0 * F.log2(F.col("n") / 4.0))).alias("entropy"))
    times = rows.groupBy("group").agg(F.sum("seconds").alias("s"), F.sum(F.col("seconds").cast("double") * F.col("seconds")).alias("q"))
    mean = F.floor(F.col("s") / 4)
    dev = F.sqrt(F.col("q") - 2 * mean * F.col("s") + 4 * mean * mean)
    return entropy.where("rows = 4").join(times, "group").select("group", "entropy", mean.cast("long").alias("mean_time"), dev.alias("root_sum_square"))
