"""Filters and labellers on rows written by hand."""

from pyspark.sql import functions as F

from larkspur.functions import text as X
from larkspur.corpus import Corpus
from larkspur.operators import filters, labels
from larkspur.registry import OPERATORS, Spec


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "identifier long, document string")


def kept(df):
    return sorted(r["identifier"] for r in df.collect())


def test_like_folds_ascii_only_and_has_wildcards(spark):
    d = docs(spark, "HTTP://x", "rtfm", "RT a", "a_b", "É", "back\\slash")
    assert kept(filters.drop_like(d, filters.pattern_of("http"))) == [2, 3, 4, 5, 6]
    assert kept(filters.keep_like(d, filters.pattern_of("RT", before=False))) == [2, 3]
    assert kept(filters.keep_like(d, filters.pattern_of("t_"))) == [1, 2, 3]
    assert kept(filters.keep_like(d, filters.pattern_of("é"))) == []
    assert kept(filters.keep_like(d, filters.pattern_of("k\\s"))) == [6]


def test_unique_filters(spark):
    d = docs(spark, "a", "a", "b", "b http://1", "b http://2", "c")
    assert kept(filters.unique_documents(d)) == [3, 4, 5, 6]
    assert kept(filters.unique_text(d)) == [6]
    # the last pair in order is never compared
    assert kept(filters.unique_text(docs(spark, "a", "z", "z"))) == [1, 2, 3]
    assert kept(filters.unique_text(docs(spark, "a", "z", "z", "z"))) == [1, 4]
    assert kept(filters.unique_text(docs(spark, "a"))) == [1]


def test_line_breaks(spark):
    assert kept(filters.drop_line_breaks(docs(spark, "a\nb", "a b"))) == [2]


def test_label_filters(spark):
    d = docs(spark, "x", "y", "z")
    lab = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "document_identifier long, label long")
    assert kept(filters.label_filter(d, lab, [0])) == [2, 3]
    assert kept(filters.label_filter(d, lab, most_popular=1)) == [2, 3]
    assert kept(filters.without_label(d, lab)) == [3]
    assert kept(filters.with_label(d, lab)) == [1, 2]


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_literal_labels(spark):
    d = docs(spark, ":)", ";)", ":-)", ";-)", ":D", ":-D", ":(", ":-(", "D:", ":) D:", "=)", ": )", ": (", "")
    assert values(d, labels.emoticon(F.col("document"))) == [1] * 6 + [-1] * 3 + [None] * 5
    d = docs(spark, "abc :)", "abc :(", ":) :(", "", "!" * 20)
    assert values(d, labels.emoticon(F.col("document"))) == [1, -1, None, None, None]
    assert values(d, labels.special_characters(F.col("document"))) == [2, 2, 4, 0, 20]
    assert values(d, labels.probably_spam(F.col("document"))) == [0, 0, 1, 0, 1]
    assert values(d, labels.length_bin(F.length("document"), 4)) == [4, 4, 0, 0, 16]


def test_token_labels_are_numbered_in_order(spark):
    d = docs(spark, "#b x #a #a", "#c", "none")
    got = {(r["document_identifier"], r["token"], r["label"]) for r in labels.token_labels(d, labels.hash_tags(F.col("document")), 5).collect()}
    assert got == {(1, "#a", 5), (1, "#b", 6), (2, "#c", 7)}


def test_two_labellers_of_one_table(spark):
    """The second goes on after the greatest label, also if that is 0."""
    c = Corpus(spark, {"input": docs(spark, "#a @b", "@c")})
    for name in ("HashTagLabeller", "AtMentionLabeller"):
        c = OPERATORS[name].run(c, Spec(name, {"dest": "x"}))
    assert sorted(tuple(r) for r in c.labels("x").collect()) == [(1, 0), (1, 1), (2, 2)]


def test_numbers_have_no_gaps_over_many_partitions(spark):
    df = spark.range(1000).select(F.format_string("%05d", F.col("id")).alias("k")).repartition(7)
    got = sorted((r["k"], r["label"]) for r in labels.number(df, "k").collect())
    assert [n for _, n in got] == list(range(1000))


def test_bigrams_and_words(spark):
    d = docs(spark, "Hello-world again tiny words, matter")
    assert values(d, labels.bigrams(F.col("document")))[0] == ["Hello world", "world again", "again words", "words matter"]
    assert values(d, labels.basic_words(F.col("document")))[0] == ["again", "matter"]


def test_split_share(spark):
    d = spark.range(20_000).select(F.col("id").alias("identifier"))
    share = d.select(F.avg(labels.split_label(F.col("identifier"), 0.3))).first()[0]
    assert abs(share - 0.3) < 0.02


def test_tweet_tokens(spark):
    d = docs(spark, "Hello, #Tag! @me 9lives it's  !", "")
    assert values(d, X.tweet_tokens(F.col("document"))) == [["hello", "#tag", "@me", "9lives", "it", "!"], []]
    d = docs(spark, ":) ;-D 123abc 'quoted' é abc:)def #a@b!", "x  :")
    assert values(d, X.tweet_tokens(F.col("document"))) == [[":)", ";-d", "123abc", "'quoted'", "é", "abc", "#a@b"], ["x", ":"]]
    assert values(d, X.regexp_stem(F.lit("running")))[0] == "runn"


def test_filters_are_idempotent(spark):
    d = docs(spark, "the a", "b", "b", "RT c")
    for f in (filters.unique_documents, filters.drop_line_breaks, lambda x: filters.drop_like(x, "%the%")):
        assert kept(f(f(d))) == kept(f(d))
