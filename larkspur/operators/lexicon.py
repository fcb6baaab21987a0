"""Lexicon scores of words and documents.

A lexicon is a table (word, pos, id, positive, negative), a row per word and synset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..corpus import Corpus
from ..functions.text import words
from ..registry import Spec, operator


def strengths(lexicon: DataFrame) -> DataFrame:
    """word, max_positive, max_negative over its synsets."""
    return lexicon.groupBy("word").agg(F.max("positive").cast("double").alias("max_positive"), F.max("negative").cast("double").alias("max_negative"))


def objectivity(lexicon: DataFrame) -> DataFrame:
    """word, score: the mean of 1 - (positive + negative) over its distinct synsets."""
    one = lexicon.select("word", "pos", "id", "positive", "negative").dropDuplicates(["word", "pos", "id"])
    return one.groupBy("word").agg(F.avg(1.0 - (F.col("positive") + F.col("negative")).cast("double")).alias("score"))


def polarity(lexicon: DataFrame) -> DataFrame:
    """word, score: the mean of positive - negative."""
    return lexicon.groupBy("word").agg(F.avg((F.col("positive") - F.col("negative")).cast("double")).alias("score"))


def _words(df: DataFrame) -> DataFrame:
    return df.select("identifier", F.explode(words(F.lower("document"))).alias("word"))


def strength_labels(df: DataFrame, lexicon: DataFrame, threshold: float, either: bool = False) -> DataFrame:
    """(document_identifier, label): 1 if a word's strength reaches threshold, else 0.

    either: the negative strength counts as well.
    """
    s = strengths(lexicon)
    value = F.greatest("max_positive", "max_negative") if either else F.col("max_positive")
    strong = s.where(value >= threshold).select("word")
    hit = _words(df).join(strong, "word", "left_semi").select("identifier").distinct().withColumn("hit", F.lit(1))
    return df.select("identifier").join(hit, "identifier", "left").select(F.col("identifier").alias("document_identifier"), F.coalesce("hit", F.lit(0)).cast("long").alias("label"))


def subjectivity(df: DataFrame, scores: DataFrame, name: str = "subjectivity") -> DataFrame:
    """df with the mean score of a document's known words, 0 without any."""
    mean = _words(df).join(scores, "word").groupBy("identifier").agg(F.avg("score").alias(name))
    return df.join(mean, "identifier", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def disambiguate(tokens: DataFrame, glosses: DataFrame) -> DataFrame:
    """Lesk: (document_identifier, at, synset) of tokens with a single synset, or one whose gloss
    shares words with the document; the greatest overlap wins, ties to the smaller synset.

    tokens: (document_identifier, at, token); glosses: (word, synset, gloss).
    """
    context = tokens.groupBy("document_identifier").agg(F.collect_set(F.lower("token")).alias("context"))
    senses = tokens.withColumn("word", F.lower("token")).join(glosses, "word").join(context, "document_identifier")
    overlap = F.size(F.array_intersect(F.col("context"), words(F.lower("gloss"))))
    scored = senses.select("document_identifier", "at", "synset", overlap.alias("overlap"))
    best = scored.groupBy("document_identifier", "at").agg(F.count("*").alias("n"), F.max(F.struct("overlap")).alias("m"), F.min(F.struct((-F.col("overlap")).alias("o"), F.col("synset").alias("s"))).alias("b"))
    return best.where((F.col("n") == 1) | (F.col("m.overlap") > 0)).select("document_identifier", "at", F.col("b.s").alias("synset"))


def synset_distance(df: DataFrame, tokens: DataFrame, similarity: DataFrame, dollar: bool = True, name: str = "distance") -> DataFrame:
    """df with the mean, over target synsets, of the best similarity among its tokens.

    tokens: (document_identifier, synset); similarity: (synset, target, similarity).  1.0 where
    the document holds $ and dollar is set; null without any.
    """
    return mean_best(df, tokens.join(similarity, "synset"), dollar, name)


def mean_best(df: DataFrame, found: DataFrame, dollar: bool, name: str) -> DataFrame:
    """df with the mean over targets of the best similarity of found (document_identifier, target, similarity)."""
    best = found.groupBy("document_identifier", "target").agg(F.max("similarity").alias("s"))
    mean = best.groupBy("document_identifier").agg(F.avg("s").alias("_mean"))
    out = df.join(mean, df["identifier"] == mean["document_identifier"], "left").drop("document_identifier")
    value = F.when(F.col("document").contains("$") & F.lit(dollar), F.lit(1.0)).otherwise(F.col("_mean"))
    return out.withColumn(name, value).drop("_mean")


@operator("DomainSpecificAnnotator", ("column", "domain"))
def _in_domain(c: Corpus, s: Spec) -> Corpus:
    """A column of input is kept for the documents of one domain only, and null elsewhere."""
    named = c.table("label_names_domains").where(F.col("label") == s.get("domain")).select(F.col("label_identifier").alias("label"))
    labels = c.table("label_domains").join(F.broadcast(named), "label").select("document_identifier", F.lit(1).alias("label"))
    return c.with_input(in_domain(c.input, labels, 1, s.get("column")))


def in_domain(df: DataFrame, labels: DataFrame, domain: int, column: str) -> DataFrame:
    """df with column set to null outside one domain label."""
    inside = labels.where(F.col("label") == domain).select(F.col("document_identifier").alias("identifier")).distinct().withColumn("_in", F.lit(True))
    return df.join(inside, "identifier", "left").withColumn(column, F.when(F.col("_in"), F.col(column))).drop("_in")


def _strength(name: str, either: bool):
    @operator(name, ("dest", "threshold"), ("lexicon",))
    def run(c: Corpus, s: Spec) -> Corpus:
        made = strength_labels(c.input, c.table(s.get("lexicon", "lexicon")), s.get("threshold", kind=float), either)
        table = f"temporary_label_{s.get('dest')}"
        return c.with_table(table, c.table(table).select("document_identifier", "label").unionByName(made) if c.has(table) else made)

    return run


_strength("SentiWordNetPositiveStrengthLabeller", False)
_strength("SentiWordNetPositiveOrNegativeStrengthLabeller", True)


@operator("SubjectivityAnnotator", (), ("lexicon", "outputColumn"))
def _subjectivity(c: Corpus, s: Spec) -> Corpus:
    return c.with_input(subjectivity(c.input, objectivity(c.table(s.get("lexicon", "lexicon"))), s.get("outputColumn", "subjectivity")))


@operator("WordSenseDisambiguate", ("table",), ("glosses",))
def _wsd(c: Corpus, s: Spec) -> Corpus:
    name = s.get("table")
    off = c.dependent(f"pos_off_{name}")
    found = disambiguate(off.select("document_identifier", F.col("start").alias("at"), F.col("word").alias("token")), c.table(s.get("glosses", "glosses")))
    return c.with_table(f"pos_off_{name}", off.drop("synset").join(found.withColumnRenamed("at", "start"), ["document_identifier", "start"], "left"))


def compatible(tokens: DataFrame, target: str = "target") -> Column:
    """Whether a tag may have a synset's part of speech: the target's second part, as in word.n.01, against
    the tag after the token's last slash; tokens without a tag fit any."""
    kind = F.element_at(F.split(F.col(target), r"\."), -2)
    tag = F.upper(F.when(F.col("token").contains("/"), F.element_at(F.split("token", "/"), -1)))
    starts = F.create_map(*[F.lit(x) for kv in (("n", "N"), ("v", "V"), ("a", "J"), ("s", "J"), ("r", "R")) for x in kv])
    return tag.isNull() | F.startswith(tag, F.try_element_at(starts, kind)) | ((kind == "a") & (tag == "A"))


@operator("FinancialDistanceAnnotator", ("pos",), ("annotateStockTweets", "similarity", "outputColumn", "hypernyms", "senses"))
def _financial(c: Corpus, s: Spec) -> Corpus:
    """Nested Synset elements name the targets.  The table similarity has (word, target, similarity): the best path
    similarity of any sense of a word.  With the attribute hypernyms, which names a table (synset, hypernym), it is computed from that graph and
    the table senses (word, synset), for which targets must be named.  A named target that a document's tags fit
    counts 0 where nothing is similar to it; targets that no tag fits don't count."""
    from .hypernyms import similarities
    from .tokens import tokens_of

    wanted = sorted({x.get("text") for x in s.all("Synset")})
    rows = tokens_of(c, s.get("pos")).withColumn("word", F.lower(F.regexp_replace("token", "/[^/]*$", "")))
    graph = s.get("hypernyms")
    if graph and not wanted:
        raise ValueError("FinancialDistanceAnnotator with hypernyms needs Synset elements")
    if graph:
        table = similarities(c.table(s.get("senses", "senses")), c.table(graph), c.spark.createDataFrame([(w,) for w in wanted], "target string"))
    else:
        table = c.table(s.get("similarity", "similarity"))
    table = table.where(F.col("target").isin(wanted)) if wanted else table
    fit = rows.join(table, "word").where(compatible(rows)).select("document_identifier", "target", "similarity")
    if wanted:
        named = rows.withColumn("target", F.explode(F.array(*[F.lit(w) for w in wanted])))
        zeros = named.where(compatible(named)).select("document_identifier", "target", F.lit(0.0).alias("similarity")).distinct()
        fit = fit.unionByName(zeros)
    return c.with_input(mean_best(c.input, fit, s.get("annotateStockTweets", False, bool), s.get("outputColumn", "distance")))
