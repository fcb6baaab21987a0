"""Labellers: one integer per document, or one for each distinct token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import durable
from ..corpus import Corpus
from ..functions.text import pairs, words
from ..registry import Spec, operator

#: fixed values
GOOD = (":)", ";)", ":-)", ";-)", ":D", ":-D")
BAD = (":(", ":-(", "D:")


def literal_labels(df: DataFrame, value: Column) -> DataFrame:
    """(document_identifier, label) of rows where value isn't null."""
    return df.select(F.col("identifier").alias("document_identifier"), value.cast("long").alias("label")).where("label IS NOT NULL")


def token_labels(df: DataFrame, tokens: Column, first: int = 0) -> DataFrame:
    """(document_identifier, label, token): distinct tokens, numbered in their order from first on.

    Numbers come from a dictionary of the distinct tokens: it is range-partitioned, each
    partition counts its tokens, and a token's number is its place plus the counts before,
    so no task sorts all tokens.
    """
    rows = df.select(F.col("identifier").alias("document_identifier"), F.explode(F.array_distinct(tokens)).alias("token"))
    return rows.join(number(rows.select("token").distinct(), "token", first), "token").select("document_identifier", "label", "token")


def number(distinct: DataFrame, by: str, first: int = 0, name: str = "label") -> DataFrame:
    """Rows of distinct values with their place in the order, from first on.

    Range bounds are sampled, so the partitions are written once and both steps read the
    same ones, also when a task is run again.
    """
    parted = durable(distinct.repartitionByRange(by).withColumn("_part", F.spark_partition_id()))
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.expr("coalesce(sum(_n) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("_before"))
    placed = parted.withColumn("_at", F.expr(f"row_number() OVER (PARTITION BY _part ORDER BY {by})"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, (F.col("_at") + F.col("_before") - 1 + first).cast("long")).drop("_part", "_at", "_before")


def hash_tags(text: Column) -> Column:
    return F.filter(words(text), lambda w: w.startswith("#"))


def mentions(text: Column) -> Column:
    return F.filter(words(text), lambda w: w.startswith("@"))


def basic_words(text: Column) -> Column:
    return F.filter(words(text), lambda w: w.rlike("^[A-Za-z]{5,}$"))


def bigrams(text: Column) -> Column:
    """Non-alphanumerics are spaces; words over four letters, in adjacent pairs."""
    return pairs(F.filter(words(F.regexp_replace(text, "[^A-Za-z0-9]", " ")), lambda w: F.length(w) > 4))


def length_bin(size: Column, bin_size: int) -> Column:
    """int((size - binSize // 2) / binSize) * binSize, towards zero."""
    return ((size - bin_size // 2).cast("double") / bin_size).cast("long") * bin_size


def special_characters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[A-Za-z ]", ""))


def probably_spam(text: Column) -> Column:
    """1 if over 140 characters or over 2 + 12/140 of the length are special."""
    n = F.length(text)
    return F.when((n > 140) | (special_characters(text).cast("double") > F.lit(2.0) + F.lit(12.0) / F.lit(140.0) * n), 1).otherwise(0)


def emoticon(text: Column) -> Column:
    """1 with good emoticons only, -1 with bad ones only, else null."""

    def any_of(xs):
        hit = F.lit(False)
        for x in xs:
            hit = hit | text.contains(x)
        return hit

    good, bad = any_of(GOOD), any_of(BAD)
    return F.when(good & ~bad, 1).when(bad & ~good, -1)


def split_label(identifier: Column, share: float, seed: int = 0) -> Column:
    """1 (test) for about share of all ids, by a hash that any SQL can compute."""
    return F.when((F.pmod(identifier + seed, F.lit(1_000_003)) * F.lit(2654435761)) % 1000 < int(round(share * 1000)), 1).otherwise(0)


def _literal(name: str, value, required: tuple[str, ...] = (), optional: tuple[str, ...] = ()):
    @operator(name, ("dest", *required), optional)
    def run(c: Corpus, s: Spec) -> Corpus:
        table = f"temporary_label_{s.get('dest')}"
        made = literal_labels(c.input, value(s))
        return c.with_table(table, c.table(table).select("document_identifier", "label").unionByName(made) if c.has(table) else made)

    return run


def _enumerating(name: str, tokens):
    @operator(name, ("dest",))
    def run(c: Corpus, s: Spec) -> Corpus:
        table = f"temporary_label_{s.get('dest')}"
        first = 0
        if c.has(table):
            first = c.table(table).agg(F.coalesce(F.max("label"), F.lit(-1))).first()[0] + 1
        made = token_labels(c.input, tokens(F.col("document")), first).select("document_identifier", "label")
        return c.with_table(table, c.table(table).select("document_identifier", "label").unionByName(made) if c.has(table) else made)

    return run


_literal("LengthLabeller", lambda s: length_bin(F.length("document"), s.get("binSize", kind=int)), ("binSize",))
_literal("SpecialCharacterLengthLabeller", lambda s: length_bin(special_characters(F.col("document")), s.get("binSize", kind=int)), ("binSize",))
_literal("ProbablySpamUnicodeLabeller", lambda s: probably_spam(F.col("document")))
_literal("EmoticonLabeller", lambda s: emoticon(F.col("document")))
_literal("TrainingTestSplitLabeller", lambda s: split_label(F.col("identifier"), s.get("testProportion", kind=float), s.get("seed", 0, int)), ("testProportion",), ("seed",))
_enumerating("HashTagLabeller", hash_tags)
_enumerating("AtMentionLabeller", mentions)
_enumerating("BasicWordLabeller", basic_words)
_enumerating("BigramLabeller", bigrams)


def signature_size(labels: DataFrame, bits: int = 64) -> DataFrame:
    """One row: the average number of labels of a document that has any, and how many hash functions a signature of so many bits takes."""
    per = labels.groupBy("document_identifier").agg(F.count("*").alias("c")).agg(F.avg("c").alias("average"))
    return per.withColumn("functions", F.round(bits / F.col("average") * F.log(F.lit(2.0))).cast("long"))


def dictionary_labels(df: DataFrame, label: Column) -> tuple[DataFrame, DataFrame]:
    """(names, associations) of a text label: a dictionary and a bridge."""
    rows = df.select(F.col("identifier").alias("document_identifier"), label.cast("string").alias("label")).where("label IS NOT NULL")
    names = number(rows.select("label").distinct(), "label", 1, "label_identifier").select("label_identifier", "label")
    bridge = rows.join(names, "label").select("document_identifier", F.col("label_identifier").alias("label"))
    return names, bridge
