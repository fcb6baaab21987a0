"""Corpus readers: delimited text, crowd work, archives, lexicons, feeds.

Every reader returns DataFrames; identifiers come from the order of distinct texts, so
they don't depend on the order of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoint import durable
from ..corpus import Corpus
from ..functions.text import words
from ..operators.annotations import clean
from ..operators.labels import dictionary_labels, number
from ..registry import Spec, operator


def _strings(n: int) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n)])


def read_delimited(spark: SparkSession, path: str, columns: dict[str, int], sep: str = ",", header: bool = True, suffix: str | None = None) -> DataFrame:
    """Columns of a delimited file or folder by position; quotes may hold line ends."""
    reader = spark.read.schema(_strings(max(columns.values()) + 1)).option("header", str(header).lower()).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", "true").option("recursiveFileLookup", "true").option("enforceSchema", "true")
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.csv(path).select(*(F.col(f"c{i}").alias(n) for n, i in columns.items()))


def as_input(rows: DataFrame, source: str) -> DataFrame:
    """(identifier, document, date, source, label): one row for each row read, numbered by text and label."""
    one = rows.where("document IS NOT NULL").withColumn("_key", F.concat_ws("\x01", "document", F.coalesce("label", F.lit("")))).groupBy("_key").agg(F.first("document").alias("document"), F.first("label").alias("label"), F.count("*").alias("_n"))
    one = one.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).withColumn("_key", F.concat_ws("\x01", "_key", F.lpad(F.col("_copy").cast("string"), 9, "0")))
    return number(one.select("_key", "document", "label"), "_key", 1, "identifier").select("identifier", "document", F.current_timestamp().alias("date"), F.lit(source).alias("source"), "label")


def sanders(spark: SparkSession, path: str) -> DataFrame:
    return as_input(read_delimited(spark, path, {"label": 1, "document": 4}, suffix=".csv"), "sanders")


def sascha(spark: SparkSession, path: str) -> DataFrame:
    return as_input(read_delimited(spark, path, {"label": 0, "document": 3}, "\t", suffix=".tsv"), "sascha")


def semval(spark: SparkSession, path: str, source: str = "semval") -> DataFrame:
    return as_input(read_delimited(spark, path, {"label": 2, "document": 3}, "\t", suffix=".tsv"), source)


def sentences(spark: SparkSession, path: str) -> DataFrame:
    """(document, label): lower-cased texts of rows labelled positive (1) or negative (-1)."""
    rows = read_delimited(spark, path, {"label": 1, "document": 4})
    return rows.select(F.lower("document").alias("document"), F.expr("CASE label WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 END").alias("label")).where("label IS NOT NULL")


def labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    """(document, label) of lines ``label,"text"`` with labels 1 and -1."""
    rows = read_delimited(spark, path, {"label": 0, "document": 1}, header=False)
    return rows.select("document", F.col("label").try_cast("int").alias("label")).where("label IN (1, -1)")


def own_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(document, label) of rows of which some of the five votes has three or more."""
    rows = read_delimited(spark, path, {"document": 0, **{f"v{i}": i for i in range(1, 6)}})
    return voted(rows.select("document", F.array(*(F.col(f"v{i}").try_cast("int") for i in range(1, 6))).alias("votes")))


def voted(rows: DataFrame) -> DataFrame:
    n = F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda v: F.struct(F.size(F.filter("votes", lambda x: x == v)).alias("n"), v.alias("v")))
    best = F.array_max(n)
    return rows.where(best["n"] >= 3).select("document", best["v"].cast("string").alias("label"))


def in_file() -> Column:
    """Where a line stands: its file, the block of the file, and its place in that."""
    return F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("k"))


def paint(spans: DataFrame) -> DataFrame:
    """(uid, sid, text, annotation) from (uid, sid, start, end, polarity, text): word ranges, ends included.

    "Not Available" texts go; of several texts the last in the file counts (by the column place; without it the
    greatest); objective spans leave no mark; where spans overlap the one that starts last shows.
    """
    code = F.expr("CASE polarity WHEN 'positive' THEN 'p' WHEN 'negative' THEN 'n' WHEN 'neutral' THEN 'e' END")
    place = F.col("place") if "place" in spans.columns else F.col("text")
    rows = spans.where("text <> 'Not Available'").groupBy("uid", "sid").agg(F.max_by("text", place).alias("text"), F.sort_array(F.collect_list(F.when(code.isNotNull(), F.struct("start", "end", code.alias("m"))))).alias("s"))
    last = lambda i: F.coalesce(F.element_at(F.filter("s", lambda x: (x["start"] <= i) & (x["end"] >= i)), -1)["m"], F.lit("q"))
    n = F.size(words(F.col("text")))
    # element_at of an empty array is an error in ANSI mode, so an all-covering mark stands first
    rows = rows.withColumn("s", F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(2**31 - 1).alias("end"), F.lit("q").alias("m"))), "s"))
    return rows.select("uid", "sid", "text", F.array_join(F.transform(F.sequence(F.lit(0), n - 1), last), "").alias("annotation"))


def semeval_spans(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", "\t", 6)
    rows = spark.read.text(path).select(in_file().alias("place"), *(parts[i].alias(n) for i, n in enumerate(("uid", "sid", "start", "end", "polarity", "text"))))
    return rows.select("uid", "sid", F.col("start").try_cast("int").alias("start"), F.col("end").try_cast("int").alias("end"), "polarity", "text", "place").where("start IS NOT NULL AND end IS NOT NULL AND text IS NOT NULL")


def crowd_work(spark: SparkSession, path: str) -> DataFrame:
    """(document, annotation, sentiment, file) of approved assignments; columns are found by name, file is the path as it was given."""
    rows = spark.read.option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().getPath()
    below = F.substring_index(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), root, -1)
    return rows.where("AssignmentStatus = 'Approved'").select(F.col("`Input.tweet`").alias("document"), clean(F.col("`Answer.subphrases`")).alias("annotation"), F.col("`Answer.sentiment`").alias("sentiment"), F.concat(F.lit(path.rstrip("/")), below).alias("file"))


def hit_phrases(spark: SparkSession, path: str) -> DataFrame:
    """(document, phrase, text, sentiment) of work in the wide layout: two texts to a row, up to four phrases to a text.

    The first phrase has columns of its own; the begins of the others stand in one column with bars between them, and
    their ends and sentiments in three columns each.  A text without a first phrase has none, and phrases
    end with the first end that is missing.
    """
    rows = spark.read.option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true").csv(path)
    made = None
    for text, more in (("Input.tweet", ""), ("Input.tweet2", "second")):
        col = lambda name: F.coalesce(F.col(f"`Answer.{name}{more}`") if f"Answer.{name}{more}" in rows.columns else F.lit(None).cast("string"), F.lit(""))  # noqa: E731, B023
        begins = F.filter(F.split(col("phrase2begin"), "[|]"), lambda x: x != "")
        ends = F.array(*(col(f"phrase{k}end") for k in (2, 3, 4)))
        cut = F.array_position(ends, "")
        n = F.least(F.size(begins), F.when(cut == 0, 3).otherwise(cut - 1).cast("int"))
        later = F.arrays_zip(F.slice(begins, F.lit(1), n).alias("a"), F.slice(ends, F.lit(1), n).alias("z"), F.slice(F.array(*(col(f"sentimentphrase{k}") for k in (2, 3, 4))), F.lit(1), n).alias("s"))
        first = F.array(F.struct(col("phrase1begin").alias("a"), col("phrase1end").alias("z"), col("sentimentphrase1").alias("s")))
        found = F.when((col("phrase1begin") != "") & (col("phrase1end") != ""), F.concat(first, later))
        one = rows.select(F.col(f"`{text}`").alias("document"), F.posexplode(found).alias("at", "x")).select("document", (F.col("at") + 1).alias("phrase"), F.col("x.a").cast("int").alias("a"), F.col("x.z").cast("int").alias("z"), F.col("x.s").alias("sentiment"))
        made = one if made is None else made.union(one)
    part = F.slice(F.split("document", " "), F.greatest(F.col("a"), F.lit(1)), F.greatest(F.col("z") - F.greatest(F.col("a"), F.lit(1)) + 1, F.lit(0)))
    return made.select("document", "phrase", F.array_join(part, " ").alias("text"), "sentiment")


def numbered(rows: DataFrame, columns: list[str], first: int = 1) -> DataFrame:
    """rows with an identifier in the order of columns; equal rows are counted, and numbered each."""
    key = F.concat_ws("\x01", *(F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in columns))
    one = rows.groupBy(*columns).agg(F.count("*").alias("_n")).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    one = one.withColumn("_key", F.concat_ws("\x01", key, F.lpad(F.col("_copy").cast("string"), 19, "0")))
    return number(one, "_key", first, "identifier").select("identifier", *columns)


def associate(c: Corpus, name: str, rows: DataFrame) -> Corpus:
    """c with further (identifier, label) rows in the label table of that name; known labels keep their numbers."""
    names, bridge = f"label_names_{name}", f"label_{name}"
    rows = rows.where("label IS NOT NULL").select(F.col("identifier").alias("document_identifier"), F.col("label").cast("string").alias("label"))
    if not c.has(names):
        made, added = dictionary_labels(rows.withColumnRenamed("document_identifier", "identifier"), F.col("label"))
        return c.with_table(names, made).with_table(bridge, added)
    known = c.table(names).select("label_identifier", "label")
    most = known.agg(F.coalesce(F.max("label_identifier"), F.lit(0))).first()[0]
    fresh = number(rows.select("label").distinct().join(known, "label", "left_anti"), "label", most + 1, "label_identifier")
    both = durable(known.unionByName(fresh.select("label_identifier", "label")))
    added = rows.join(both, "label").select("document_identifier", F.col("label_identifier").alias("label"))
    return c.with_table(names, both).with_table(bridge, c.table(bridge).select("document_identifier", "label").unionByName(added))


def appended(c: Corpus, rows: DataFrame) -> Corpus:
    return c.with_input(c.input.unionByName(rows, allowMissingColumns=True) if c.has("input") else rows)


def greatest(c: Corpus, table: str = "input") -> int:
    return c.table(table).agg(F.coalesce(F.max("identifier"), F.lit(0))).first()[0] if c.has(table) else 0


def crowd_corpus(spark: SparkSession, rows: DataFrame, c: Corpus | None = None) -> Corpus:
    """c, or an empty corpus, with one subphrases row and labels of sentiment and file for each assignment, and input rows for
    texts that it doesn't have yet."""
    c = c or Corpus(spark)
    texts = rows.where("document IS NOT NULL").select("document").distinct()
    if c.has("input"):
        texts = texts.join(c.input.select("document"), "document", "left_anti")
    docs = number(texts, "document", greatest(c) + 1, "identifier").select("identifier", "document", F.current_timestamp().alias("date"), F.lit("train").alias("source"))
    c = appended(c, durable(docs))
    first = c.input.groupBy("document").agg(F.min("identifier").alias("document_identifier"))
    with_id = durable(rows.join(first, "document"))
    sub = numbered(with_id, ["document_identifier", "annotation", "sentiment", "file"], greatest(c, "subphrases") + 1).drop("file")
    c = c.with_table("subphrases", c.table("subphrases").unionByName(sub) if c.has("subphrases") else sub)
    for name, column in (("sentiment", "sentiment"), ("amt", "file")):
        c = associate(c, name, with_id.select(F.col("document_identifier").alias("identifier"), F.col(column).alias("label")))
    return c


def tweet_archives(spark: SparkSession, path: str) -> DataFrame:
    """(document, date) of all compressed databases below a folder whose metadata say TWEET_TEXT.

    An archive is opened by the task that gets its bytes; its rows are handed on in parts.
    """
    import pyarrow as pa

    def run(it):
        import lzma
        import sqlite3

        for batch in it:
            for data in batch.column(0):
                con = sqlite3.connect(":memory:")
                con.deserialize(lzma.decompress(data.as_py()))
                kind = con.execute("SELECT value FROM metadata WHERE key = 'data_format'").fetchone()
                if kind and kind[0] == "TWEET_TEXT":
                    rows = con.execute("SELECT response, date FROM stream")
                    while part := rows.fetchmany(10_000):
                        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.string()), pa.array([None if r[1] is None else str(r[1]) for r in part], pa.string())], names=["document", "date"])
                con.close()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xz").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, "document string, date string").withColumn("date", F.try_to_timestamp("date"))


def senti_word_net(spark: SparkSession, path: str) -> DataFrame:
    """(word, pos, id, positive, negative) of a tab-separated lexicon.  Deviation: synsets are keyed by part of speech and id."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(parts) >= 5) & (F.trim(parts[0]) != ""))
    rows = rows.select(parts[0].alias("pos"), parts[1].alias("id"), parts[2].cast("double").alias("positive"), parts[3].cast("double").alias("negative"), F.explode(F.split(parts[4], " ")).alias("term"))
    return rows.select(F.lower(F.regexp_replace("term", "#[0-9]+$", "")).alias("word"), "pos", "id", "positive", "negative").where("word <> ''")


def subjectivity_clues(spark: SparkSession, path: str) -> DataFrame:
    """(word, type, polarity, strong, weak) of lines of key=value; a word's last line counts.

    strong and weak: 1 or -1 by the polarity of a clue of that type, else 0.
    """
    sign = F.expr("CASE polarity WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END")
    rows = spark.read.text(path).select(in_file().alias("at"), F.str_to_map(F.col("value"), F.lit(" "), F.lit("=")).alias("m"))
    return rows.where("m['word1'] IS NOT NULL").groupBy(F.col("m")["word1"].alias("word")).agg(F.max_by(F.struct(F.col("m")["type"].alias("type"), F.col("m")["priorpolarity"].alias("polarity")), "at").alias("b")).select("word", "b.type", "b.polarity").withColumns({k: F.when(F.col("type") == f"{k}subj", sign).otherwise(0) for k in ("strong", "weak")})


def pivots(spark: SparkSession, path: str) -> DataFrame:
    """(pivot): the first column of each row, with _pivot after it."""
    return read_delimited(spark, path, {"word": 0}, header=False).select(F.concat("word", F.lit("_pivot")).alias("pivot"))


def sequences(spark: SparkSession, path: str, fields: tuple[str, ...] = ("w", "pos", "y")) -> DataFrame:
    """(items: array of structs) of sequences apart by blank lines."""
    rows = spark.read.option("lineSep", "\n\n").text(path).where("trim(value) <> ''")
    item = lambda x: F.struct(*(F.get(F.split(x, " "), i).alias(n) for i, n in enumerate(fields)))
    return rows.select(F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), item).alias("items"))


def feed_items(feeds: DataFrame) -> DataFrame:
    """(source, headline, summary) from (source, xml): an item's title and its description up to the first full stop."""
    both = feeds.select("source", F.posexplode(F.arrays_zip(F.expr("xpath(xml, '//item/title/text()')").alias("headline"), F.expr("xpath(xml, '//item/description/text()')").alias("summary"))).alias("at", "i"))
    return both.select("source", F.col("i.headline").alias("headline"), F.split(F.col("i.summary"), r"\.")[0].alias("summary"))


def timeline(statuses: DataFrame, limit: int = 200) -> DataFrame:
    """(user, document) of each user's newest statuses (user, date, document), ``limit`` at most, without quotes and links."""
    newest = statuses.withColumn("_r", F.expr("row_number() OVER (PARTITION BY user ORDER BY date DESC, document)")).where(F.col("_r") <= limit)
    return newest.select("user", strip_links(F.col("document")).alias("document"))


def strip_links(text):
    """Quotes and links go."""
    return F.regexp_replace(F.regexp_replace(text, r"https?://\S+", ""), "[\"']", "")


def _labelled(name: str, read, table: str, signs: bool = False):
    @operator(name, ("dir",), ("source", "create"))
    def run(c: Corpus, s: Spec) -> Corpus:
        base = greatest(c)
        rows = durable(read(c.spark, s).withColumn("identifier", F.col("identifier") + base))
        c = associate(appended(c, rows.select("identifier", "document", "date", "source")), table, rows.select("identifier", "label"))
        if not signs:
            return c
        made = rows.select(F.col("identifier").alias("document_identifier"), F.expr("CASE label WHEN 'positive' THEN 1L WHEN 'negative' THEN -1L END").alias("label")).where("label IS NOT NULL")
        t = f"temporary_label_{table}"
        return c.with_table(t, c.table(t).select("document_identifier", "label").unionByName(made) if c.has(t) else made)

    return run


_labelled("SandersInputSource", lambda p, s: sanders(p, s.get("dir")), "sanders", True)
_labelled("SaschaInputSource", lambda p, s: sascha(p, s.get("dir")), "sascha")
_labelled("SemvalInputSource", lambda p, s: semval(p, s.get("dir"), s.get("source", "semval")), "semval")
_labelled("OurInputSource", lambda p, s: as_input(own_corpus(p, s.get("dir")), "own"), "own")


@operator("TwitterInputSource", ("dir",))
def _twitter(c: Corpus, s: Spec) -> Corpus:
    """All rows of all archives, repeated ones too."""
    rows = numbered(tweet_archives(c.spark, s.get("dir")), ["document", "date"], greatest(c) + 1)
    return appended(c, rows.select("identifier", "document", "date", F.lit("twitter").alias("source")))


@operator("AMTInputSource", (), ("file", "dir"))
def _crowd(c: Corpus, s: Spec) -> Corpus:
    if (s.get("file") is None) == (s.get("dir") is None):
        raise ValueError("AMTInputSource takes either file or dir")
    return crowd_corpus(c.spark, crowd_work(c.spark, s.get("file") or s.get("dir")), c)


@operator("SemEvalTaskAImport", ("path", "key"))
def _semeval(c: Corpus, s: Spec) -> Corpus:
    """Every text is labelled by the attribute key (sem), and by its uid and sid."""
    rows = paint(semeval_spans(c.spark, s.get("path"))).withColumn("_key", F.concat_ws("\x01", "uid", "sid"))
    base, sub_base = greatest(c), greatest(c, "subphrases")
    rows = durable(number(rows, "_key", base + 1, "identifier"))
    c = appended(c, rows.select("identifier", F.col("text").alias("document"), F.current_timestamp().alias("date"), F.lit(None).cast("string").alias("source")))
    sub = rows.select((F.col("identifier") - base + sub_base).alias("identifier"), F.col("identifier").alias("document_identifier"), "annotation", F.lit("Unknown").alias("sentiment"))
    c = c.with_table("subphrases", c.table("subphrases").unionByName(sub) if c.has("subphrases") else sub)
    for name, label in (("sem", F.lit(s.get("key"))), ("sid", F.col("sid")), ("uid", F.col("uid"))):
        c = associate(c, name, rows.select("identifier", label.alias("label")))
    return c
