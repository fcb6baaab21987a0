"""Short texts and annotations derived from ``documents``, in Spark and in DuckDB's SQL.

The documents have no links, tags, mentions or emoticons, so operators on short texts
get the lines of documents, all of them and whole, with such marks added by a rule on the
row's numbers.  An identifier is doc_id * 2**32 + the line's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_MARK = """CASE k WHEN 0 THEN {cat0} WHEN 1 THEN {cat1} WHEN 2 THEN {cat2} WHEN 3 THEN concat(line, ' :)')
 WHEN 4 THEN concat(line, ' :(') WHEN 5 THEN concat('RT ', line) WHEN 6 THEN concat(line, ' :) :(')
 WHEN 7 THEN concat('good Apple ', line) ELSE line END"""

_SPARK_TWEETS = (
    """SELECT CAST(doc_id * 4294967296 + p AS BIGINT) AS identifier, """
    + _MARK.format(
        cat0="concat(line, ' http://t.co/', CAST(doc_id AS STRING))",
        cat1="concat(line, ' #tag', CAST(doc_id % 13 AS STRING))",
        cat2="concat(line, ' @user', CAST(doc_id % 7 AS STRING))",
    )
    + """ AS document, lang, source FROM (
 SELECT doc_id, lang, source, p, line, (doc_id + p) % 10 AS k
 FROM (SELECT doc_id, lang, source, posexplode(split(text, '\\\\n')) AS (p, line) FROM {docs})
 WHERE length(line) > 0)"""
)

#: DuckDB: tweets(identifier, document, lang, source)
TWEETS = (
    """lines AS (
 SELECT doc_id, lang, source, unnest(generate_series(1, len(parts))) - 1 AS p, unnest(parts) AS line
 FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents)),
marked AS (SELECT doc_id, lang, source, p, line, (doc_id + p) % 10 AS k FROM lines WHERE length(line) > 0),
tweets AS (SELECT CAST(doc_id * 4294967296 + p AS BIGINT) AS identifier, """
    + _MARK.format(
        cat0="concat(line, ' http://t.co/', CAST(doc_id AS VARCHAR))",
        cat1="concat(line, ' #tag', CAST(doc_id % 13 AS VARCHAR))",
        cat2="concat(line, ' @user', CAST(doc_id % 7 AS VARCHAR))",
    )
    + """ AS document, lang, source FROM marked)"""
)

#: DuckDB, after TWEETS: ann(identifier, annotator, annotation), four annotators to a tweet
ANN = """ann AS (SELECT identifier, a AS annotator,
 array_to_string(list_transform(range(len(string_split(document, ' '))), lambda i: CASE (identifier + 7*i + 3*a*(i % 3)) % 11
  WHEN 0 THEN 'p' WHEN 1 THEN 'n' WHEN 2 THEN 'e' ELSE 'q' END), '') AS annotation
 FROM tweets, (SELECT unnest(range(4)) AS a))"""


def _period(a: int, r: int, negative: bool) -> str:
    """Marks of 33 words, after which they begin anew; remainders of negative numbers are negative, or 0."""
    k = [(r + 7 * i + 3 * a * (i % 3)) % 11 for i in range(33)]
    return "".join("p" if x == 0 else "q" if negative or x > 2 else "ne"[x - 1] for x in k)


_PERIODS = "array(" + ", ".join(f"'{_period(a, r, s)}'" for a in range(4) for s in (False, True) for r in range(11)) + ")"


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identifier, document, lang, source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql(_SPARK_TWEETS.replace("\\\\\\\\", "\\\\"), docs=docs)


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identifier, document, annotator, annotation: one character for each space-split word."""
    return spark.sql(
        f"""SELECT identifier, document, CAST(a AS INT) AS annotator, substr(repeat(p, CAST(n DIV 33 + 1 AS INT)), 1, n) AS annotation
 FROM (SELECT identifier, document, a, n,
  coalesce(element_at({_PERIODS}, CAST(a * 22 + pmod(identifier, 11) + IF(identifier < 0, 11, 0) + 1 AS INT)), repeat('q', 33)) AS p
  FROM (SELECT *, explode(sequence(0, 3)) AS a FROM (SELECT *, length(document) - length(replace(document, ' ', '')) + 1 AS n FROM {{t}})))""",
        t=tweets(spark, sf_dir),
    )
