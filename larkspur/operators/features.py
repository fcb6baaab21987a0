"""Feature matrices over n-grams: one operator with options instead of a class per export.

A matrix is kept long, (identifier, feature, value), with the vocabulary apart;
it becomes dense only on export, row by row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from ..checkpoint import durable
from ..corpus import Corpus
from ..functions.groups import by_group
from ..functions.text import letters_only, mark_count, mark_share, pairs, phrase_runs, words
from ..registry import Spec, operator
from .annotations import majority_label
from .labels import number

#: fixed values: words that carry no topic
STOP_WORDS = tuple(
    """a able about across after all almost also am among an and any are as at be because been but by can cannot could dear
did do does either else ever every for from get got had has have he her hers him his how however i if in into is it its
just least let like likely may me might most must my neither no nor not of off often on only or other our own rather
said say says she should since so some than that the their them then there these they this tis to too twas us wants was
we were what when where which while who whom why will with would yet you your""".split()
)


@dataclass(frozen=True)
class Options:
    """ngram 1 or 2; start: first position of a pair; threshold: least count of a word, before stemming
    for single words and after it for pairs; absent: the value of a feature a document lacks;
    stem: by Porter's stemmer; statistics: none, number, total or percent."""

    ngram: int = 1
    start: int = 0
    threshold: int = 5
    absent: int = 0
    stem: bool = False
    stop_words: bool = False
    statistics: str = "none"


def plain_words(text: Column, options: Options) -> Column:
    out = F.filter(words(F.lower(letters_only(text))), lambda w: w != "")
    return F.filter(out, lambda w: ~w.isin(list(STOP_WORDS))) if options.stop_words else out


def stemmed(words_: Column) -> Column:
    """Every word of an array by Porter's stemmer."""
    from pyspark.sql.pandas.functions import PandasUDFType

    from .normalise import porter

    return F.pandas_udf(lambda s: s.map(lambda ws: None if ws is None else [porter(w) for w in ws]), "array<string>", PandasUDFType.SCALAR)(words_)


def gram_lists(df: DataFrame, options: Options) -> DataFrame:
    """identifier, raw: the array of a row's words, or of its pairs of words that are stemmed already.

    A column tokens (array of strings) stands for the words of the text where df has one.
    """
    w = F.col("tokens") if "tokens" in df.columns else plain_words(F.col("document"), options)
    if options.ngram == 1:
        return df.select("identifier", w.alias("raw"))
    rows = df.select("identifier", w.alias("w"))
    if options.stem:
        rows = rows.withColumn("w", stemmed(F.col("w")))
    return rows.select("identifier", pairs(F.col("w"), options.start).alias("raw"))


def raw_grams(df: DataFrame, options: Options) -> DataFrame:
    """identifier, raw of each occurrence."""
    return gram_lists(df, options).select("identifier", F.explode("raw").alias("raw"))


COMMON = 500_000  # grams whose numbers are sent to the tasks; those of others are joined
TEXTS = 4 << 20  # bytes of texts whose grams are made at a time
_PLAIN = np.zeros(256, np.uint8)  # what plain_words makes of a byte; 0 goes
_PLAIN[[*b"abcdefghijklmnopqrstuvwxyz "]] = [*b"abcdefghijklmnopqrstuvwxyz "]
_PLAIN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = [*b"abcdefghijklmnopqrstuvwxyz"]


def _coded_words(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code, words) of the words of texts in their order, as ``plain_words`` has them: found in the bytes, without a string for each."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    chars = _PLAIN[data]
    kept = chars != 0
    ends = np.concatenate([[0], np.cumsum(kept)])[ends - ends[0]]
    chars = chars[kept]
    letter = chars != ord(" ")
    inner = ends[(ends > 0) & (ends < len(chars))]
    before, after = np.concatenate([[False], letter[:-1]])[: len(chars)], np.concatenate([letter[1:], [False]])[: len(chars)]
    before[inner], after[inner - 1] = False, False
    begin = np.flatnonzero(letter & ~before)
    sizes = np.flatnonzero(letter & ~after) + 1 - begin
    held = pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(chars[letter]))
    coded = held.dictionary_encode()
    return np.searchsorted(ends, begin, side="right") - 1, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _coded_grams(texts: pa.LargeStringArray, options: Options) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code, grams) of each occurrence: what ``gram_lists`` has of texts."""
    row, code, names = _coded_words(texts)
    if options.stop_words:
        use = ~pc.is_in(names, value_set=pa.array(STOP_WORDS)).to_numpy(zero_copy_only=False)[code]
        row, code = row[use], code[use]
    if options.ngram == 1:
        return row, code, names
    if options.stem:
        from .normalise import porter

        coded = pa.array([porter(w) for w in names.to_pylist()], pa.string()).dictionary_encode()
        code, names = coded.indices.to_numpy().astype(np.int64)[code], coded.dictionary
    at = np.arange(len(row)) - np.searchsorted(row, row)
    use = np.flatnonzero((row[:-1] == row[1:]) & (at[:-1] >= options.start))
    coded = pa.array(code[use] * len(names) + code[use + 1]).dictionary_encode()
    both = coded.dictionary.to_numpy()
    width = max(1, len(names))
    return row[use], coded.indices.to_numpy().astype(np.int64), pc.binary_join_element_wise(names.take(pa.array(both // width)), names.take(pa.array(both % width)), " ")


def _pieces(texts):
    """Texts, null ones as empty, of about ``TEXTS`` bytes at a time, one at least."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    end = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False) + 1)
    lo = 0
    while lo < len(end):
        hi = max(lo + 1, int(np.searchsorted(end, TEXTS + (end[lo - 1] if lo else 0), side="right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def gram_sums(df: DataFrame, options: Options) -> DataFrame:
    """raw, n: how often each gram occurs; it is counted by Arrow batches first, so occurrences are never rows."""
    if "tokens" in df.columns:
        return raw_grams(df, options).groupBy("raw").agg(F.count("*").alias("n"))

    def run(batches):
        for batch in batches:
            for piece in _pieces(batch.column(0)):
                _, code, names = _coded_grams(piece, options)
                n = np.bincount(code, minlength=len(names))
                held = pa.array(np.flatnonzero(n))
                yield pa.RecordBatch.from_arrays([names.take(held), pa.array(n[n > 0])], names=["raw", "n"])

    return df.select("document").mapInArrow(run, "raw string, n long").groupBy("raw").agg(F.sum("n").alias("n"))


def _coded_lists(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code, grams) of each gram of lists that isn't null."""
    flat, row = pc.list_flatten(lists).dictionary_encode(), pc.list_parent_indices(lists).to_numpy()
    code = flat.indices.fill_null(-1).to_numpy().astype(np.int64)
    return row[code >= 0], code[code >= 0], flat.dictionary


def _looked_up(sent, common: bool, options: Options | None = None):
    """A column over arrays of grams, or over texts with options: the sorted numbers of the common ones, or the other grams, each once."""

    def one(coded, rows: int):
        grams_, numbers = sent.value
        row, code, names = coded
        found = pc.fill_null(pc.index_in(names, value_set=grams_), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        value, top = (numbers[found], numbers.max(initial=0)) if common and len(numbers) else (np.arange(len(names)), len(names))
        use = (found >= 0)[code] == common
        width = int(top) + 1
        keys = np.unique(row[use] * width + value[code[use]])
        ends = np.concatenate([[0], np.cumsum(np.bincount(keys // width, minlength=rows))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys % width) if common else names.take(pa.array(keys % width)))

    def run(column):
        if options is None:
            return one(_coded_lists(column), len(column))
        made = [one(_coded_grams(piece, options), len(piece)) for piece in _pieces(column)]
        return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.int64() if common else pa.string()))

    return F.arrow_udf(run, f"array<{'bigint' if common else 'string'}>", ArrowUDFType.SCALAR)


def held_parts(df: DataFrame, numbers: DataFrame, options: Options, common: int = COMMON) -> DataFrame:
    """identifier, features: numbers of grams that a document holds, in one row or several; numbers: (raw, feature, n), kept.

    Numbers of up to ``common`` grams, the most frequent, go to every task, which looks up a document's grams in place; only other
    grams are shuffled, once for each document, and joined.
    """
    every, upto, least = 0, 0, float("inf")
    for r in numbers.groupBy(F.floor(F.log2("n") * 8).alias("b")).count().orderBy(F.desc("b")).collect():  # a few hundred steps
        every += r["count"]
        upto, least = (every, r["b"]) if every <= common else (upto, least)
    step = F.floor(F.log2("n") * 8)
    first = numbers.where(step >= least).select("raw", "feature").toArrow().combine_chunks()
    sent = df.sparkSession.sparkContext.broadcast((pa.array(first.column("raw").to_pylist(), pa.string()), first.column("feature").to_numpy()))
    lists, own = (gram_lists(df, options), None) if "tokens" in df.columns else (df.select("identifier", F.col("document").alias("raw")), options)
    made = lists.select("identifier", _looked_up(sent, True, own)("raw").alias("features"))
    if every > upto:
        rest = lists.select("identifier", F.explode(_looked_up(sent, False, own)("raw")).alias("raw")).join(numbers.where(step < least).select("raw", "feature"), "raw")
        made = made.union(rest.select("identifier", F.array("feature")))
    return made


def _merged(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, numbers) of the sorted distinct numbers of each row's lists."""
    inner = pc.list_flatten(lists)
    row = pc.list_parent_indices(lists).to_numpy()[pc.list_parent_indices(inner).to_numpy()]
    value = pc.list_flatten(inner).to_numpy().astype(np.int64)
    width = int(value.max(initial=0)) + 1
    keys = np.unique(row * width + value)
    return np.concatenate([[0], np.cumsum(np.bincount(keys // width, minlength=len(lists)))]).astype(np.int32), keys % width


def held_features(df: DataFrame, numbers: DataFrame, options: Options, common: int = COMMON) -> DataFrame:
    """identifier, features: the sorted numbers of the grams that a document holds (``held_parts``)."""

    def run(ids, lists):
        ends, values = _merged(lists)
        yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["identifier", "features"])

    parts = held_parts(df, numbers, options, common)
    return by_group(parts, "identifier", run, f"identifier {parts.schema['identifier'].dataType.simpleString()}, features array<bigint>")


def _beside_features(rows: DataFrame, parts: DataFrame, sparse: bool) -> DataFrame:
    """rows (identifier, ...) with the features of their document, or with their sparse text, null if there are none, as held.

    Rows and features (``held_parts``) of a document meet in one group, where features are sorted and written once for all rows.
    """
    x = F.struct(*(c for c in rows.columns if c != "identifier"))
    rows = rows.select("identifier", F.lit(None).cast("array<bigint>").alias("features"), x.alias("x"))
    type_ = rows.schema["x"].dataType.simpleString()
    both = rows.unionByName(parts.where("identifier IS NOT NULL").select("identifier", "features", F.lit(None).cast(type_).alias("x")))

    def run(ids, lists, own):
        ends, values = _merged(lists)
        if sparse:
            text = pc.binary_join_element_wise(pa.array(values).cast(pa.string()), "1", " ")
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), text), ", ")
            made = pc.if_else(pa.array(np.diff(ends) > 0), text, pa.scalar(None, pa.string()))
        else:
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
        yield pa.RecordBatch.from_arrays([made.take(pc.list_parent_indices(own)), pc.list_flatten(own)], names=["held", "x"])

    made = by_group(both, "identifier", run, f"held {'string' if sparse else 'array<bigint>'}, x {type_}")
    return made.select(F.col("held").alias("held" if sparse else "features"), "x.*")


def grams(df: DataFrame, options: Options) -> DataFrame:
    """identifier, raw, gram of each occurrence."""
    rows = raw_grams(df, options)
    return rows.withColumn("gram", stemmed(F.array("raw"))[0] if options.stem and options.ngram == 1 else F.col("raw"))


def gram_table(df: DataFrame, options: Options, lemmas: DataFrame | None = None) -> DataFrame:
    """raw, gram, n: grams whose raw count n reaches the threshold; words are stemmed, then looked up in lemmas (word, lemma), once each."""
    counts = gram_sums(df, options).where(F.col("n") >= options.threshold)
    made = counts.withColumn("gram", stemmed(F.array("raw"))[0] if options.stem and options.ngram == 1 else F.col("raw"))
    if lemmas is None:
        return made
    table = lemmas.groupBy(F.col("word").alias("_word")).agg(F.min("lemma").alias("_lemma"))
    return made.join(table, F.col("gram") == F.col("_word"), "left").select("raw", F.lower(F.coalesce("_lemma", "gram")).alias("gram"), "n")


def gram_counts(df: DataFrame, options: Options) -> DataFrame:
    """gram, n over all documents, for grams that reach the threshold."""
    made = gram_table(df, options)
    return made.groupBy("gram").agg(F.sum("n").alias("n")) if options.stem and options.ngram == 1 else made.select("gram", "n")


def vocabulary(df: DataFrame, options: Options) -> DataFrame:
    """gram, feature: the sorted vocabulary numbered from 0."""
    return number(gram_table(df, options).select("gram").distinct(), "gram", 0, "feature")


def presence(df: DataFrame, vocabulary_: DataFrame, options: Options) -> DataFrame:
    """identifier, feature of every gram that a document holds."""
    return grams(df, options).select("identifier", "gram").distinct().join(vocabulary_, "gram").select("identifier", "feature")


_MARKS = (("p", "positive"), ("n", "negative"), ("e", "neutral"))


def statistics(df: DataFrame, annotation: str, kind: str) -> DataFrame:
    """df with the counts (number), their sum (total) or shares (percent) of an annotation's marks."""
    a = F.col(annotation)
    names = _MARKS
    if kind == "number":
        return df.withColumns({f"num_{n}": phrase_runs(a, m).cast("long") for m, n in names})
    if kind == "total":
        return df.withColumn("num_subjective", sum((phrase_runs(a, m) for m, _ in names[1:]), phrase_runs(a, "p")).cast("long"))
    if kind == "percent":
        return df.withColumns({f"percent_{n}": mark_share(a, F.col("document"), m) for m, n in names})
    return df


def csv_rows(rows: DataFrame, size: int, absent: int, extra: list[str], sparse: bool = False) -> DataFrame:
    """One line of text for each row: features, then extra columns.

    Features (sorted numbers) are written densely, the gaps between them as runs of the absent value, or
    sparsely as {number value, ...} for the values that aren't zero; a column held has the sparse text of features.
    """
    if sparse:
        tail = [F.concat(F.lit(f"{size + k} "), F.col(e).cast("string")) for k, e in enumerate(extra)]
        held = F.array("held") if "held" in rows.columns else F.transform("features", lambda x: F.concat(x.cast("string"), F.lit(" 1")))
        return rows.select(F.concat(F.lit("{"), F.array_join(F.concat(held, F.array(*tail).cast("array<string>")), ", "), F.lit("}")).alias("value"))
    f = F.col("features")
    gap = f"{absent},"
    before = F.concat(F.array(F.lit(-1).cast("bigint")), f)
    runs = F.zip_with(f, F.slice(before, F.lit(1), F.size(f)), lambda x, y: F.concat(F.repeat(F.lit(gap), (x - y - 1).cast("int")), F.lit("1,")))
    rest = F.repeat(F.lit(gap), F.lit(size) - 1 - F.coalesce(F.array_max(f), F.lit(-1)).cast("int"))
    line = F.concat(F.array_join(runs, ""), rest, F.array_join(F.array(*[F.coalesce(F.col(e).cast("string"), F.lit("?")) for e in extra]), ",") if extra else F.lit(""))
    return rows.select(F.regexp_replace(line, ",$", "").alias("value"))


def attribute_line(name: Column) -> Column:
    """The line that declares a numeric attribute; names of other than letters, digits and _ are quoted."""
    quoted = F.concat(F.lit("'w_"), F.regexp_replace(F.regexp_replace(name, r"\\", r"\\\\"), "'", r"\\'"), F.lit("'"))
    return F.concat(F.lit("@attribute "), F.when(name.rlike("^[A-Za-z0-9_]+$"), F.concat(F.lit("w_"), name)).otherwise(quoted), F.lit(" numeric"))


def header_lines(names: DataFrame, relation: str, extra: list[str]) -> DataFrame:
    """(place, value) of an ARFF header: the vocabulary (gram, feature) stays distributed; extra are whole attribute lines.

    Attributes of words begin with w_, others with x_, so none can take the name of another.
    """
    few = names.sparkSession.createDataFrame([(-1, f"@relation {relation}"), *((2**40 + k, x) for k, x in enumerate([*extra, "@data"]))], "place long, value string")
    return few.union(names.select(F.col("feature").cast("long").alias("place"), attribute_line(F.col("gram")).alias("value")))


def word_shares(df: DataFrame, annotations: DataFrame) -> DataFrame:
    """identifier, word, positive, neutral, negative: sums of mark shares of a word within a document."""
    from .annotations import word_marks

    return word_marks(df, annotations, "shares")


def phrases(df: DataFrame, annotations: DataFrame) -> DataFrame:
    """identifier, phrase, at, length: runs of positions that most annotators mark, islands by position."""
    from pyspark.sql import Window

    from .annotations import positions

    hit = positions(annotations).groupBy("identifier", "at").agg(F.avg((F.col("mark") != "q").cast("double")).alias("s")).where("s > 0.5")
    w = Window.partitionBy("identifier").orderBy("at")
    island = hit.withColumn("_g", F.col("at") - F.row_number().over(w))
    runs = island.groupBy("identifier", "_g").agg(F.min("at").alias("at"), F.count("*").alias("length"))
    return runs.withColumn("phrase", F.row_number().over(w)).select("identifier", "phrase", "at", "length")


def consensus(annotations: DataFrame) -> DataFrame:
    """identifier, class: the sentiment that most annotations give, noconsensus on a tie."""
    return majority_label(annotations, "sentiment").select("identifier", F.coalesce("sentiment", F.lit("noconsensus")).alias("class"))


def mutual_information(presence_: DataFrame, labels: DataFrame) -> DataFrame:
    """feature, mi: empirical mutual information, in nats, of a feature's presence and a label.

    presence_: (identifier, feature); labels: (identifier, label).  Counts of absence
    follow from the totals, so only present features are counted.
    """
    per = labels.groupBy("label").agg(F.count("*").alias("nl")).collect()  # a row for each class
    n = sum(r["nl"] for r in per)
    classes = F.array(*[F.struct(F.lit(r["label"]).alias("label"), F.lit(r["nl"]).alias("nl")) for r in per])
    both = presence_.join(labels, "identifier").groupBy("feature", "label").agg(F.count("*").alias("c"))
    sums = both.groupBy("feature").agg(F.sum("c").alias("nf"))
    if not per:
        return sums.select("feature", F.lit(0.0).alias("mi"))
    grid = sums.select("feature", "nf", F.inline(classes))
    grid = grid.join(both, ["feature", "label"], "left").fillna(0, ["c"]).withColumn("n", F.lit(n))
    term = lambda x, f: F.when(x > 0, x / F.col("n") * F.log(x * F.col("n") / (f * F.col("nl")))).otherwise(0.0)
    mi = term(F.col("c").cast("double"), F.col("nf")) + term((F.col("nl") - F.col("c")).cast("double"), F.col("n") - F.col("nf"))
    return grid.groupBy("feature").agg(F.sum(mi).alias("mi"))


def discrete_marks(df: DataFrame, annotations: DataFrame) -> DataFrame:
    """identifier, word, mark: the majority mark of a word within a document, q on a tie."""
    from .annotations import word_marks

    return word_marks(df, annotations, "majority")


def phrase_means(df: DataFrame, annotations: DataFrame) -> DataFrame:
    """identifier, phrase, membership, positive, neutral, negative: mean shares over each phrase's positions."""
    from .annotations import positions

    marks = positions(annotations.select("identifier", "annotation"))
    shares = marks.groupBy("identifier", "at").agg(F.avg((F.col("mark") != "q").cast("double")).alias("membership"), *(F.avg((F.col("mark") == m).cast("double")).alias(n) for m, n in (("p", "positive"), ("e", "neutral"), ("n", "negative"))))
    spots = phrases(df, annotations).select("identifier", "phrase", F.explode(F.sequence(F.col("at"), (F.col("at") + F.col("length") - 1).cast("int"))).alias("at"))
    return spots.join(shares, ["identifier", "at"]).groupBy("identifier", "phrase").agg(*(F.avg(n).alias(n) for n in ("membership", "positive", "neutral", "negative")))


def subjectivity_flags(df: DataFrame, annotations: DataFrame) -> DataFrame:
    """identifier, word, subjectivity (greatest share of marks other than q), present (1)."""
    from .annotations import subjectivity_vector

    rows = df.select("identifier", F.posexplode(words(F.lower("document"))).alias("at", "word"))
    return rows.join(subjectivity_vector(annotations), ["identifier", "at"]).groupBy("identifier", "word").agg(F.max("share").alias("subjectivity"), F.lit(1).alias("present"))


#: exports of a long table with the class of each document: name -> table of (documents, annotations)
LONG_EXPORTERS = {
    "SubjectivePhraseTweetClassficationDiscreteARFFExporter": discrete_marks,
    "SubjectivePhraseTweetClassificationARFFExporter": phrase_means,
    "SubjectivePhraseARFFExporter": phrases,
    "SubjectiveWordARFFExporter": word_shares,
    "SubjectiveARFFExporter": subjectivity_flags,
}


_COMMON = ("outputTable", "useStopWords", "stopWords", "threshold", "stem", "lemmise", "relation", "sparse")


def _long_exporter(name: str, make):
    @operator(name, ("path",), (*_COMMON, "exportLevel", "exportPresence", "exportSubjectivity", "normaliseCase", "stemmer", "normalisingRExp", "lemmatise", "stopPos"))
    def run(c: Corpus, s: Spec) -> Corpus:
        """A row for each value, with the class of its document; words are normalised first where attributes ask for it."""
        from ..sources.sinks import write_text
        from .normalise import Normaliser, normalised_words

        sub = c.dependent("subphrases").select(F.col("document_identifier").alias("identifier"), "annotation", "sentiment")
        made = make(c.input, sub.select("identifier", "annotation"))
        if "word" in made.columns and any(s.get(k) for k in ("stemmer", "normalisingRExp", "stopWords", "normaliseCase")):
            options = Normaliser(s.get("stopWords", False, bool), s.get("stemmer", "none"), s.get("normaliseCase", True, bool), s.get("normalisingRExp"))
            distinct = made.select(F.col("word").alias("document")).distinct().withColumn("identifier", F.monotonically_increasing_id())
            table = normalised_words(durable(distinct), options, c.table("lemmas") if s.get("lemmatise", False, bool) else None)
            names = durable(distinct).join(table, "identifier").groupBy("document").agg(F.min("word").alias("_word"))
            made = made.join(names, F.col("word") == F.col("document")).withColumn("word", F.col("_word")).drop("document", "_word").where("word NOT IN ('STOPPED', 'FILTERED')")
        rows = made.join(consensus(sub), "identifier")
        kinds = {"string": "string", "class": "{positive,neutral,negative,noconsensus}"}
        head = [f"@relation {s.get('relation', 'corpus')}", *(f"@attribute {n} {kinds['class'] if n == 'class' else kinds.get(t, 'numeric')}" for n, t in rows.dtypes), "@data"]
        quoted = [F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(n, r"\\", r"\\\\"), "'", r"\\'"), F.lit("'")) if t == "string" and n != "class" else F.coalesce(F.col(n).cast("string"), F.lit("?")) for n, t in rows.dtypes]
        write_text(s.get("path"), c.spark.createDataFrame(list(enumerate(head)), "place long, value string"), rows.select(F.concat_ws(",", *quoted).alias("value")))
        return c

    return run


for _n, _f in LONG_EXPORTERS.items():
    _long_exporter(_n, _f)


EXPORTERS = {
    "BigramBinaryPresenceTotalNumberSubjectiveARFFExporter": Options(2, 1, statistics="total"),
    "BigramBinaryPresenceNumberSubjectiveARFFExporter": Options(2, 1, statistics="number"),
    "BigramBinaryPresencePercentageSubjectiveARFFExporter": Options(2, 0, statistics="percent"),
    "BigramBinaryPresenceARFFExporter": Options(2, 1),
    "UnigramBinaryPresenceWithTotalNumberOfSubjectivePhrasesARFFExporter": Options(1, statistics="total"),
    "UnigramBinaryPresenceWithNumberOfSubjectivePhrasesARFFExporter": Options(1, statistics="number"),
    "UnigramBinaryPresenceWithPercentageSubjectiveARFFExporter": Options(1, statistics="percent"),
    "UnigramBinaryPresenceARFFExporter": Options(1),
}
_STATISTICS = {"none": [], "total": ["num_subjective"], "number": ["num_positive", "num_negative", "num_neutral"], "percent": ["percent_positive", "percent_negative", "percent_neutral"]}
_SIGN = "CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END"


def chosen(options: Options, s: Spec) -> Options:
    """Options with what a step's attributes say; a threshold of 1 keeps every gram."""
    stop = s.get("useStopWords", s.get("stopWords", False, bool), bool)
    return replace(options, threshold=s.get("threshold", 1, int), stem=s.get("stem", False, bool), stop_words=stop)


def feature_rows(c: Corpus, rows: DataFrame, options: Options, lemmas: DataFrame | None = None, sparse: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vocabulary of all documents, rows with features): gram, feature; and the sorted feature numbers of each row's document.

    rows has one row for each line to come, several for a document if need be.
    """
    table = durable(gram_table(c.input, options, lemmas))
    names = durable(number(table.select("gram").distinct(), "gram", 0, "feature"))
    numbers = durable(table.join(names, "gram").select("raw", "feature", "n"))
    return names, _beside_features(rows, held_parts(c.input, numbers, options), sparse)


def export(c: Corpus, s: Spec, rows: DataFrame, options: Options, extra: dict[str, str], header: bool = True) -> None:
    """Write ARFF text in two parts of a folder: the header, and a line for each of rows with its features and extra columns (name -> type)."""
    from ..sources.sinks import write_text

    lemmas, sparse = c.table("lemmas") if s.get("lemmise", False, bool) else None, s.get("sparse", False, bool)
    names, made = feature_rows(c, rows.select("identifier", *extra), options, lemmas, sparse)
    lines = header_lines(names, s.get("relation", "corpus"), [f"@attribute x_{n} {t}" for n, t in extra.items()]) if header else None
    write_text(s.get("path"), lines, csv_rows(made, names.count(), options.absent, list(extra), sparse))


def annotated(c: Corpus, kind: str = "none") -> DataFrame:
    """identifier, sentiment and statistics (``statistics``) of each annotation of a document; neither texts nor annotations are shuffled."""
    sub = c.dependent("subphrases").select(F.col("document_identifier").alias("identifier"), "annotation", "sentiment")
    if kind != "percent":
        return c.input.select("identifier").join(statistics(sub, "annotation", kind).drop("annotation"), "identifier")
    own = sub.select("identifier", "sentiment", *(mark_count(F.col("annotation"), m).alias(f"percent_{n}") for m, n in _MARKS))
    both = c.input.select("identifier", F.size(words(F.col("document"))).alias("_n")).join(own, "identifier")
    return both.withColumns({f"percent_{n}": F.col(f"percent_{n}").cast("double") / F.col("_n") for _, n in _MARKS}).drop("_n")


def labelled(c: Corpus, table: str, source: str) -> DataFrame:
    """identifier, document, sentiment: documents of a source by their labels in a table."""
    names = c.table(f"label_names_{table}").select(F.col("label_identifier").alias("label"), F.col("label").alias("sentiment"))
    labels = c.table(f"label_{table}").join(names, "label").select(F.col("document_identifier").alias("identifier"), "sentiment")
    return c.input.where(F.col("source") == source).join(labels, "identifier").select("identifier", "document", "sentiment")


def training_rows(c: Corpus) -> DataFrame:
    """Distinct documents and labels of both training sources.  Deviation: both are joined by document."""
    return labelled(c, "sentiment", "train").union(labelled(c, "semval", "train_semval")).distinct()


def _exporter(name: str, options: Options, tagged: bool = False):
    @operator(name, ("path",), _COMMON)
    def run(c: Corpus, s: Spec) -> Corpus:
        own = c
        if tagged:  # ids of tagged tokens stand for words
            ids = c.dependent("pos_gimpel").select(F.col("document_identifier").alias("identifier"), F.col("tokens").cast("array<string>").alias("tokens"))
            own = c.with_input(c.input.join(ids, "identifier"))
        extra = {e: "numeric" for e in _STATISTICS[options.statistics]} | {"sentiment": "{positive,negative,neutral}"}
        export(own, s, annotated(own, options.statistics), chosen(options, s), extra)
        return c

    return run


for _n, _o in EXPORTERS.items():
    _exporter(_n, _o)
_exporter("BigramBinaryPresencePercentageSubjectiveGimpelTaggedARFFExporter", Options(2, 0, statistics="percent"), True)


def _sem_eval(name: str, options: Options):
    @operator(name, ("path",), (*_COMMON, "source"))
    def run(c: Corpus, s: Spec) -> Corpus:
        """Rows of the training sources, or of the test source; the class is 1, 0 or -1."""
        rows = training_rows(c) if s.get("source") == "train" else labelled(c, "semval", "test").distinct()
        export(c, s, rows.withColumn("sentiment_label", F.expr(_SIGN)), chosen(options, s), {"sentiment_label": "{1,0,-1}"})
        return c

    return run


_sem_eval("SemEvalUnigramDataExporter", Options(1))
_sem_eval("SemEvalBigramDataExporter", Options(2, 0))


@operator("CrossDomainUnigramDataExporter", ("path", "domain"), _COMMON)
def _cross_domain(c: Corpus, s: Spec) -> Corpus:
    """Rows of one domain, without a header; the vocabulary is that of all documents, the class a number."""
    named = c.table("label_names_domains").where(F.col("label") == s.get("domain")).select(F.col("label_identifier").alias("label"))
    inside = c.table("label_domains").join(F.broadcast(named), "label").select(F.col("document_identifier").alias("identifier"))
    rows = annotated(c).join(inside, "identifier", "left_semi").withColumn("sentiment", F.expr(_SIGN))
    export(c, s, rows, chosen(Options(1), s), {"sentiment": "numeric"}, header=False)
    return c


@operator("CrossDomainUnigramPivotDataExporter", ("path", "pivots"), (*_COMMON, "test_domain"))
def _pivots(c: Corpus, s: Spec) -> Corpus:
    """Rows of the training sources with a column for each pivot word after the words; absent is -1, and there is no class.

    Deviation: pivots have columns of their own after the last word, and one that isn't in the vocabulary is absent.
    """
    from ..sources.corpora import pivots

    words_ = sorted({r["pivot"] for r in pivots(c.spark, s.get("pivots")).collect()})  # columns of the file to write
    options = replace(chosen(Options(1), s), absent=-1)
    rows = training_rows(c).select("identifier", "document").distinct()
    held = F.array_distinct(plain_words(F.col("document"), options))
    made = rows.withColumns({p: F.when(F.array_contains(held, p.removesuffix("_pivot")), 1).otherwise(-1) for p in words_})
    export(c, s, made, options, dict.fromkeys(words_, "numeric"))
    return c
