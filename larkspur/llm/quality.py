"""Quality rules: hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Words and pairs of adjacent words are hashed to 2**16 buckets.  Two multinomials over
the buckets are counted: one over all documents (the raw corpus), one over all
documents labelled as good (the trusted target).  A bucket's weight is
``round(1000 * ln((t + PRIOR) / (e + PRIOR)))``, where t is its count in the target and e
the count to expect there if the target were like the raw corpus, so a bucket that the target
is too small to tell about weighs little.  A document's ratio is the sum of its
n-grams' weights, in integers, divided by their number.
Documents at or over a threshold are kept, others not: the verdict on a text depends on
the counts and that text alone.

Everything runs in Spark's own functions; the weights (65,536 integers, whatever the
input) reach the tasks as a literal.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

BUCKETS = 1 << 16
PRIOR = 10.0
THRESHOLD = -100  # thousandths of a nat per n-gram
FEW_WORDS = 10
WINDOW = 5
REPEATED_PERCENT = 20

_SPACES = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), _SPACES), "")


def _bucket(*words: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*words), 48).cast("int")


def _starts(words: Column, n: int) -> Column:
    """0 to the start of the last run of n words; empty if there are fewer words."""
    return F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))


def ngram_weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """The weight of each bucket; trusted has the ids of good documents."""
    # the numbers grow with the input: both sides are shuffled by them, whatever their size
    ids = save(trusted.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").distinct(), "trusted")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marked = texts.join(ids.withColumn("good", F.lit(1)).hint("merge"), "id", "left").select("good", _words(F.col("text")).alias("w"))
    grams = F.concat(F.transform("w", lambda w: _bucket(w)), F.transform(_starts(F.col("w"), 2), lambda i: _bucket(F.get("w", i), F.get("w", i + 1))))
    counts = marked.select("good", F.explode(grams).alias("b")).groupBy("b").agg(F.count("*").alias("raw"), F.count("good").alias("target"))
    counts = save(counts, "buckets")
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("r"), F.coalesce(F.sum("target"), F.lit(0)).alias("t")).first()
    if not total["t"]:  # nothing is trusted: every n-gram is as likely in either
        return [0] * BUCKETS
    expected = F.col("raw") * F.lit(total["t"] / total["r"])
    weighed = counts.select("b", F.round(F.log((F.col("target") + PRIOR) / (expected + PRIOR)) * 1000).cast("int").alias("weight")).collect()
    out = [0] * BUCKETS  # an n-gram of no document says nothing
    for r in weighed:
        out[r["b"]] = r["weight"]
    return out


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with words (array ``_w``), the four counts and base_failed.

    Words that stand in windows found twice: equal windows are put next to each other
    by sorting (hash, position), and the gaps between their sorted positions, 5 at
    most, add up to the words they cover.  Only texts with such windows are sorted.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn("_w", _words(F.col(text_col))).withColumn("_l", F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0))
    windows = F.transform(_starts(F.col("_w"), WINDOW), lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(WINDOW))))
    out = out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_h": windows,
        }
    )
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("_s", lambda x, k: F.coalesce(F.get("_s", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_s", k + 1)["h"] == x["h"], F.lit(False)))
    out = out.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.sequence(F.lit(1), F.size("_p") - 1), F.lit(WINDOW), lambda a, k: a + F.least(F.lit(WINDOW), F.get("_p", k) - F.get("_p", k - 1)))
    out = out.withColumn("n_repeat_words", F.coalesce(F.when(F.size("_p") > 1, covered), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < FEW_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_l", "_h", "_s", "_p")


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio and kept.

    kept: not base_failed, and the sum of weights is at least threshold times the number of
    n-grams.  ratio is that sum divided by the number (null without words).  A null
    or empty text has no words and fails; repeated rows get the same verdict; rows with a null id are judged
    but never trusted; of columns with the names of results the input's are replaced; an empty table gives no rows.
    """
    weights = F.from_json(F.lit(json.dumps(ngram_weights(docs, trusted, id_col, text_col))), "array<int>")
    out = base_rules(docs, text_col)
    one = F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.get(weights, _bucket(w)))
    two = F.aggregate(_starts(F.col("_w"), 2), F.lit(0).cast("long"), lambda a, i: a + F.get(weights, _bucket(F.get("_w", i), F.get("_w", i + 1))))
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(0))
    out = out.withColumn("_sum", one + two)
    kept = ~F.col("base_failed") & (F.col("_sum") >= threshold * grams)
    out = out.withColumns({"kept": kept, "ratio": F.when(grams > 0, F.col("_sum") / grams)})
    # Catalyst moves a filter on a result below the steps it is made of, and puts their expressions into
    # each other's lambdas, where they are evaluated for every element.  A generator of one row stops that.
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio"]
    own = [c for c in docs.columns if c not in results]
    return out.select(*own, F.explode(F.array(F.struct(*results))).alias("_r")).select(*own, *(F.col(f"_r.{c}").alias(c) for c in results))
