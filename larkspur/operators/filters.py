"""Document filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..corpus import Corpus
from ..functions.text import like_ascii, without_urls
from ..registry import Spec, operator


def pattern_of(text: str, before: bool = True, after: bool = True) -> str:
    """before: any text may stand before; after: any text may follow."""
    return ("%" if before else "") + text + ("%" if after else "")


def drop_like(df: DataFrame, pattern: str) -> DataFrame:
    """Rows whose document is LIKE the pattern go; % and _ in it are wildcards."""
    return df.where(~like_ascii(F.col("document"), pattern))


def keep_like(df: DataFrame, pattern: str) -> DataFrame:
    return df.where(like_ascii(F.col("document"), pattern))


def drop_line_breaks(df: DataFrame) -> DataFrame:
    return df.where(~F.col("document").contains("\n"))


def unique_documents(df: DataFrame) -> DataFrame:
    """Every copy of a repeated text goes.

    Texts are counted and looked up by 128-bit hashes.  The count has partial sums, and a join without the
    right side's rows is one whose skewed partitions Spark splits, so a text that a third of all rows share
    is no hot group.
    """
    rows = df.withColumn("_key", _hash("document"))
    repeated = rows.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key")
    return rows.join(repeated, "_key", "left_anti").drop("_key")


def _hash(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def unique_text(df: DataFrame) -> DataFrame:
    """In the order of documents without link tokens, both of an adjacent equal pair go;
    the last pair is never compared.

    Position in the global order isn't needed: equal texts are adjacent, so a row is
    dropped if its text has several rows, except where the last pair ends the order.
    That pair is found from the greatest text alone, so there is no single-partition sort.
    """
    rows = df.withColumn("_text", without_urls(F.col("document"))).withColumn("_key", _hash("_text"))
    counts = rows.groupBy("_key").agg(F.count("*").alias("_n"), F.max("identifier").alias("_last"))
    last = rows.agg(F.max("_text").alias("_end")).select(_hash("_end").alias("_end"))  # one row
    # of the greatest text's n rows the pair (n-1, n) isn't compared: with n = 2 both stay, with more the last
    kept = counts.join(F.broadcast(last), F.col("_key") == F.col("_end"), "left")
    at_end = F.col("_end").isNotNull()
    all_stay = (F.col("_n") == 1) | (at_end & (F.col("_n") == 2))
    kept = kept.where(all_stay | at_end).select(F.col("_key"), F.when(all_stay, F.lit(None).cast("long")).otherwise(F.col("_last")).alias("_only"))
    return rows.join(kept, "_key").where(F.col("_only").isNull() | (F.col("identifier") == F.col("_only"))).select(*df.columns)


def popular(labels: DataFrame, count: int) -> DataFrame:
    """The count most frequent labels, ties to the smaller."""
    return labels.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(count)


def label_filter(df: DataFrame, labels: DataFrame, retain: list[int] | None = None, most_popular: int | None = None) -> DataFrame:
    """Documents with any label outside the retained set go; those without labels stay."""
    if most_popular is not None:
        kept = popular(labels, most_popular).select("label")
        outside = labels.join(F.broadcast(kept), "label", "left_anti")
    else:
        outside = labels.where(~F.col("label").isin([int(x) for x in retain or []]))
    return df.join(outside.select(F.col("document_identifier").alias("identifier")).distinct(), "identifier", "left_anti")


def without_label(df: DataFrame, labels: DataFrame) -> DataFrame:
    return df.join(labels.select(F.col("document_identifier").alias("identifier")), "identifier", "left_anti")


def with_label(df: DataFrame, labels: DataFrame) -> DataFrame:
    return df.join(labels.select(F.col("document_identifier").alias("identifier")), "identifier", "left_semi")


@operator("BasicFilter", ("filterText",), ("matchBefore", "matchAfter"))
def _basic(c: Corpus, s: Spec) -> Corpus:
    return c.with_input(drop_like(c.input, pattern_of(s.get("filterText"), s.get("matchBefore", True, bool), s.get("matchAfter", True, bool))))


@operator("BasicNotFilter", ("filterText",), ("matchBefore", "matchAfter"))
def _basic_not(c: Corpus, s: Spec) -> Corpus:
    return c.with_input(keep_like(c.input, pattern_of(s.get("filterText"), s.get("matchBefore", True, bool), s.get("matchAfter", True, bool))))


@operator("LineBreakFilter")
def _line_break(c: Corpus, s: Spec) -> Corpus:
    return c.with_input(drop_line_breaks(c.input))


@operator("UniqueFilter")
def _unique(c: Corpus, s: Spec) -> Corpus:
    return c.with_input(unique_documents(c.input))


@operator("UniqueTextFilter")
def _unique_text(c: Corpus, s: Spec) -> Corpus:
    return c.with_input(unique_text(c.input))


def _after(c: Corpus, s: Spec, name: str) -> Corpus:
    """delete: the label table goes after its use."""
    if s.get("delete", False, bool):
        for t in (f"temporary_label_{name}", f"label_{name}", f"label_names_{name}"):
            c = c.without(t)
    return c


@operator("LabelFilter", ("src",), ("temporary", "delete"))
def _label_filter(c: Corpus, s: Spec) -> Corpus:
    name = s.get("src")
    most = [int(x.get("count")) for x in s.all("RetainMostPopularLabels")]
    keep = [int(x.get("id", x.get("label"))) for x in s.all("RetainLabel")]
    return _after(c.with_input(label_filter(c.input, c.labels(name), keep, most[0] if most else None)), s, name)


@operator("HasLabelFilter", ("src",), ("temporary", "delete"))
def _has_label(c: Corpus, s: Spec) -> Corpus:
    return _after(c.with_input(without_label(c.input, c.labels(s.get("src")))), s, s.get("src"))


@operator("HasNoLabelFilter", ("src",), ("temporary", "delete"))
def _has_no_label(c: Corpus, s: Spec) -> Corpus:
    return _after(c.with_input(with_label(c.input, c.labels(s.get("src")))), s, s.get("src"))


@operator("Stemmer", (), ("dest", "verbose"))
def _stemmer(c: Corpus, s: Spec) -> Corpus:
    """Lower case: a stemmer of single letters changes nothing else."""
    return c.with_input(c.input.withColumn("document", F.lower("document")))
