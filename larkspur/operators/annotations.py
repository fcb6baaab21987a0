"""Crowd annotations: one character for each space-split word (p, n, e or q for none)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from ..corpus import Corpus
from ..functions.groups import by_group
from ..functions.text import words
from ..registry import Spec, operator

MARKS = ("p", "e", "n")  # order of ties; q yields to any
SENTIMENTS = ("positive", "neutral", "negative")


def clean(annotation: Column) -> Column:
    """Bars and blanks go; then all but p, e, q, n and carets become q, so positions stay."""
    return F.regexp_replace(F.regexp_replace(annotation, r"[| ]", ""), r"[^peqn^]", "q")


def positions(rows: DataFrame, annotation: str = "annotation") -> DataFrame:
    """identifier, at, mark of each character of each annotation."""
    return rows.select("*", F.posexplode(F.split(annotation, "")).alias("at", "mark")).where("mark <> ''")


CHARACTERS = 4 << 20  # characters of annotations, or of texts, that a task counts at a time


def _ranges(*lists: pa.ListArray):
    """Ranges of rows whose strings have about ``CHARACTERS`` bytes, one row at least."""
    size = np.zeros(len(lists[0]), np.int64)
    for x in lists:
        size += np.bincount(pc.list_parent_indices(x).to_numpy(), pc.fill_null(pc.binary_length(pc.list_flatten(x)), 0).to_numpy(zero_copy_only=False), len(x)).astype(np.int64)
    end = np.cumsum(size + 1)
    lo = 0
    while lo < len(end):
        hi = max(lo + 1, int(np.searchsorted(end, CHARACTERS + (end[lo - 1] if lo else 0), side="right")))
        yield lo, hi
        lo = hi


def _placed(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions of each row, the place of each character among all rows' positions, its code point) of rows' annotations."""
    strings, row = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    n = pc.fill_null(pc.utf8_length(strings), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pc.sum(pc.binary_length(strings)).as_py() == n.sum():  # a byte each
        chars = np.frombuffer(b"".join(x or b"" for x in strings.cast(pa.binary()).to_pylist()), np.uint8)
    else:
        chars = np.frombuffer("".join(x or "" for x in strings.to_pylist()).encode("utf-32-le"), np.uint32)
    sizes = np.zeros(len(lists), np.int64)
    np.maximum.at(sizes, row, n)
    place = np.repeat((np.cumsum(sizes) - sizes)[row] - (np.cumsum(n) - n), n) + np.arange(len(chars))
    return sizes, place, chars


def _counted(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of each row, counts of p, e, n, q and other marks at each of them) of rows' annotations."""
    n, place, chars = _placed(lists)
    which = np.full(0x110000 if chars.dtype == np.uint32 else 256, 4)
    which[[ord(m) for m in "penq"]] = range(4)
    return n, np.bincount(place * 5 + which[chars], minlength=5 * n.sum()).reshape(-1, 5)


def _given(rows: DataFrame) -> DataFrame:
    """identifier, a: the annotations that aren't empty."""
    return rows.where("annotation <> ''").select("identifier", F.col("annotation").alias("a"))


def _shares(m: np.ndarray) -> np.ndarray:
    return 1.0 * (m.sum(1) - m[:, 3]) / m.sum(1)


def share_vectors(rows: DataFrame) -> DataFrame:
    """identifier, annotation: at each position the share of annotations whose mark isn't q.

    The annotations of a document meet in one group; positions are never rows, and are counted by Arrow batches.
    """
    def run(ids, lists):
        for lo, hi in _ranges(lists):
            n, m = _counted(lists.slice(lo, hi - lo))
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(_shares(m)))], names=["identifier", "annotation"])

    own = _given(rows)
    return by_group(own, "identifier", run, f"identifier {own.schema['identifier'].dataType.simpleString()}, annotation array<double>")


def beside(df: DataFrame, rows: DataFrame, text: Column, of, schema: str) -> DataFrame:
    """Rows that of(identifiers, texts, annotations) gives by Arrow batches, of documents that have a text and an annotation that isn't empty.

    The texts and annotations of a document, lists of strings, meet in one group, so neither words nor marks are shuffled.
    """
    none = F.lit(None).cast("string")
    both = df.select("identifier", text.alias("d"), none.alias("a")).unionByName(_given(rows).select("identifier", none.alias("d"), "a"))

    def run(ids, texts, annotations):
        use = pa.array((_sizes(texts) > 0) & (_sizes(annotations) > 0))
        ids, texts, annotations = (x.filter(use) for x in (ids, texts, annotations))
        for lo, hi in _ranges(texts, annotations):
            yield of(ids.slice(lo, hi - lo), texts.slice(lo, hi - lo), annotations.slice(lo, hi - lo))

    return by_group(both.where("identifier IS NOT NULL AND (d IS NOT NULL OR a IS NOT NULL)"), "identifier", run, schema)


def word_marks(df: DataFrame, rows: DataFrame, kind: str) -> DataFrame:
    """identifier, word, ...: the distinct words of a document in lower case that stand where an annotation has a mark.

    kind shares: the sums over a word's places of the shares of p, e and n; majority: the most frequent mark of its places, q on
    a tie; counts: hits and n, the marks other than q and all marks of the word's places, summed over documents of a batch,
    without identifiers.
    """
    names = {"counts": ["hits", "n"], "shares": list(SENTIMENTS), "majority": ["mark"]}[kind]
    type_ = {"counts": "bigint", "shares": "double", "majority": "string"}[kind]

    def run(ids, texts, annotations):
        own, columns = _word_groups(texts, annotations, kind)
        columns = [pa.array(c, pa.string() if kind == "majority" else None) if isinstance(c, np.ndarray) else c for c in columns]
        if kind == "counts":
            return pa.RecordBatch.from_arrays(columns, names=["word", *names])
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(own)), own))), *columns], names=["identifier", "word", *names])

    first = "" if kind == "counts" else f"identifier {df.schema['identifier'].dataType.simpleString()}, "
    return beside(df, rows, F.lower("document"), run, f"{first}word string, " + ", ".join(f"{n} {type_}" for n in names))


def _word_groups(texts: pa.ListArray, annotations: pa.ListArray, kind: str) -> tuple[np.ndarray, list]:
    """(groups of each row, columns of the groups), a group being a row and a word."""
    sizes, place, chars = _placed(annotations)
    words_ = pc.split_pattern(pc.list_flatten(texts), " ")
    row = pc.list_parent_indices(texts).to_numpy()[pc.list_parent_indices(words_).to_numpy()]
    n = pc.list_value_length(words_).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    coded = pc.list_flatten(words_).dictionary_encode()
    kept = at < sizes[row]
    row, at, code = row[kept], at[kept], coded.indices.to_numpy()[kept]
    spot = (np.cumsum(sizes) - sizes)[row] + at
    total = np.bincount(place, minlength=int(sizes.sum()))
    held = total[spot] > 0
    row, spot, code = row[held], spot[held], code[held]
    if kind == "counts":
        row = np.zeros_like(row)  # a word's marks are summed over rows
    keys, group = np.unique(row * max(1, len(coded.dictionary)) + code, return_inverse=True)
    own = np.bincount(keys // max(1, len(coded.dictionary)), minlength=len(texts))
    word = coded.dictionary.take(pa.array(keys % max(1, len(coded.dictionary))))
    over = lambda x: np.bincount(group, x[spot], len(keys))
    hits = lambda *marks: np.bincount(place, np.isin(chars, [ord(m) for m in marks]), len(total))
    if kind == "counts":
        every = over(total).astype(np.int64)
        return own, [word, every - over(hits("q")).astype(np.int64), every]
    if kind == "shares":
        return own, [word, *(over(hits(m) / np.maximum(total, 1)) for m in MARKS)]
    # each place's marks, as often as a word stands there
    known, which = np.unique(chars, return_inverse=True)
    which = which[np.argsort(place, kind="stable")]
    count = total[spot]
    at = np.repeat((np.cumsum(total) - total)[spot] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    pairs, seen = np.unique(np.repeat(group, count) * max(1, len(known)) + which[at], return_counts=True)
    first = np.flatnonzero(np.diff(pairs // max(1, len(known)), prepend=-1))
    top = np.maximum.reduceat(seen, first) if len(first) else seen
    best = seen == np.repeat(top, np.diff([*first, len(seen)]))
    alone = (np.add.reduceat(best.astype(np.int64), first) if len(first) else seen) == 1
    leader = np.flatnonzero(best)[np.searchsorted(np.flatnonzero(best), first)] if len(first) else first
    names = np.array([chr(c) for c in known] or ["q"], object)
    return own, [word, np.where(alone, names[pairs[leader] % max(1, len(known))] if len(leader) else np.zeros(0, object), "q")]


def subjectivity_vector(rows: DataFrame) -> DataFrame:
    """identifier, at, share of annotations whose mark isn't q."""
    return share_vectors(rows).select("identifier", F.posexplode("annotation").alias("at", "share"))


def vectors(shares: DataFrame) -> DataFrame:
    """identifier, annotation: array of shares by position."""
    return shares.groupBy("identifier").agg(F.sort_array(F.collect_list(F.struct("at", "share"))).alias("s")).select("identifier", F.col("s.share").alias("annotation"))


def union_votes(rows: DataFrame) -> DataFrame:
    """identifier, at, mark: the most frequent mark of the distinct annotations of a document.

    Ties go to p, then e, then n, then what is none of them; q only wins with all votes if there are four, else where it
    is alone.
    """
    def run(ids, lists):
        for lo, hi in _ranges(lists):
            found = pa.ListArray.from_arrays(*_once(lists.slice(lo, hi - lo)))
            n, m = _counted(found)
            weight = np.where(m > 0, m * 5 + [4, 3, 2, 0, 1], -1)  # p, e, n, q, others
            weight[:, 3] = np.where((m[:, 3] > 0) & (m[:, 3] < 4), 0, weight[:, 3])
            own = ids.slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(len(n)), n)))
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([own, pa.array(at, pa.int32()), pa.array(list("penq^")).take(pa.array(weight.argmax(1)))], names=["identifier", "at", "mark"])

    own = _given(rows)
    return by_group(own, "identifier", run, f"identifier {own.schema['identifier'].dataType.simpleString()}, at int, mark string")


def _once(lists: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """(offsets, strings) of lists in which every string of a row is kept once."""
    coded, row = pc.list_flatten(lists).dictionary_encode(), pc.list_parent_indices(lists).to_numpy()
    width = max(1, len(coded.dictionary))
    keys = np.unique(row * width + coded.indices.to_numpy())
    ends = np.concatenate([[0], np.cumsum(np.bincount(keys // width, minlength=len(lists)))]).astype(np.int32)
    return pa.array(ends), coded.dictionary.take(pa.array(keys % width))


def joined(marks: DataFrame, length: DataFrame) -> DataFrame:
    """identifier, annotation: marks by position, cut or padded with q to a document's words.

    length: (identifier, n).
    """
    s = marks.groupBy("identifier").agg(F.sort_array(F.collect_list(F.struct("at", "mark"))).alias("s"))
    text = F.rpad(F.array_join(F.col("s.mark"), ""), F.col("n").cast("int"), F.lit("q"))
    return s.join(length, "identifier").select("identifier", text.alias("annotation"))


def majority_sentiment(rows: DataFrame) -> DataFrame:
    """identifier, sentiment: the most frequent, ties to positive, neutral, negative."""
    n = rows.groupBy("identifier", "sentiment").agg(F.count("*").alias("n"))
    order = F.expr("CASE sentiment WHEN 'positive' THEN 3 WHEN 'neutral' THEN 2 WHEN 'negative' THEN 1 ELSE 0 END")
    return n.groupBy("identifier").agg(F.max(F.struct("n", order.alias("o"), "sentiment")).alias("b")).select("identifier", F.col("b.sentiment").alias("sentiment"))


def majority_label(rows: DataFrame, value: str = "label") -> DataFrame:
    """identifier and its most frequent value, null on a tie."""
    n = rows.groupBy("identifier", value).agg(F.count("*").alias("n"))
    top = n.groupBy("identifier").agg(F.max("n").alias("m"))
    best = n.join(top, "identifier").where("n = m").groupBy("identifier").agg(F.count("*").alias("k"), F.min(value).alias(value))
    return best.select("identifier", F.when(F.col("k") == 1, F.col(value)).alias(value))


def offsets(df: DataFrame) -> DataFrame:
    """identifier, at, word, start: where each space-split word begins, by a running sum within the text."""
    rows = df.select("identifier", words(F.col("document")).alias("w")).where("w IS NOT NULL").withColumn("s", starts(F.col("w")))
    return rows.select("identifier", F.posexplode(F.arrays_zip(F.col("w").alias("word"), F.col("s").alias("start"))).alias("at", "x")).select("identifier", "at", "x.word", "x.start")


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, pa.int64()))


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def starts(words_: Column) -> Column:
    """Where each of a text's words begins, one character apart, as an array; counted by Arrow batches."""

    def run(lists):
        n = _sizes(lists)
        size = pc.fill_null(pc.utf8_length(pc.list_flatten(lists)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        before = np.cumsum(size) - size
        return _lists(before - np.repeat(np.append(before, 0)[(np.cumsum(n) - n)], n), n)

    return F.arrow_udf(run, "array<bigint>", ArrowUDFType.SCALAR)(words_)


def nearest_places(asked: Column, starts_: Column) -> Column:
    """The place among starts_, which rise, of the one that is nearest to each asked start, of two equally near the earlier.

    Both are arrays of one row, without nulls, so nothing is joined; without starts_ the result is empty.
    """

    def run(a, s):
        na, ns = _sizes(a), _sizes(s)
        x, y = (pc.list_flatten(v).to_numpy(zero_copy_only=False).astype(np.int64) for v in (a, s))
        na = np.where(ns > 0, na, 0)
        row, own = np.repeat(np.arange(len(na)), _sizes(a)), np.repeat(np.arange(len(ns)), ns)
        x, row = x[ns[row] > 0], row[ns[row] > 0]
        if not len(x):
            return _lists(x, na)
        low = min(x.min(), y.min())
        width = int(max(x.max(), y.max()) - low) + 1
        if width * len(na) >= 2**62:
            raise ValueError("starts of one batch are too far apart")
        first = (np.cumsum(ns) - ns)[row]
        after = np.searchsorted(own * width + (y - low), row * width + (x - low))  # the first that isn't less
        before = np.maximum(after - 1, first)
        after = np.minimum(after, first + ns[row] - 1)
        return _lists(np.where(np.abs(x - y[before]) <= np.abs(y[after] - x), before, after) - first, na)

    return F.arrow_udf(run, "array<bigint>", ArrowUDFType.SCALAR)(asked, starts_)


def nearest_words(df: DataFrame, asked) -> DataFrame:
    """identifier, start, at: each start that asked (a function of the array of the words' starts) gives, once, with the nearest space-split word."""
    rows = df.select("identifier", words(F.col("document")).alias("w")).where("w IS NOT NULL").select("identifier", starts(F.col("w")).alias("s"))
    rows = rows.withColumn("a", F.array_distinct(asked(F.col("s")))).withColumn("at", nearest_places(F.col("a"), F.col("s")))
    return rows.select("identifier", F.inline(F.arrays_zip(F.col("a").alias("start"), F.col("at").alias("at")))).select("identifier", "start", F.col("at").cast("int").alias("at"))


def match_votes(df: DataFrame, annotations: DataFrame, normal: DataFrame, tokens: DataFrame) -> DataFrame:
    """tokens with counts pos, neg, neu, total of votes at their start.

    Only for documents whose normalised text equals the text.  annotations:
    (document_identifier, annotation); normal: (document_identifier, document); tokens:
    (document_identifier, start, ...).
    """
    same = df.join(normal.select(F.col("document_identifier").alias("identifier"), "document"), ["identifier", "document"], "left_semi")
    marks = positions(annotations.select(F.col("document_identifier").alias("identifier"), "annotation"))
    votes = offsets(same).join(marks, ["identifier", "at"]).groupBy(F.col("identifier").alias("document_identifier"), "start").agg(
        *(F.sum((F.col("mark") == m).cast("long")).alias(n) for m, n in (("p", "pos"), ("n", "neg"), ("e", "neu"))), F.count("*").alias("total")
    )
    out = tokens.drop("pos", "neg", "neu", "total").join(votes, ["document_identifier", "start"], "left")
    return out.fillna(0, ["pos", "neg", "neu", "total"])


@operator("AMTNormalise", (), ("table",))
def _normalise(c: Corpus, s: Spec) -> Corpus:
    """One annotation and one sentiment for each document."""
    rows = c.dependent("subphrases").withColumn("_id", F.col("document_identifier"))
    own = rows.select(F.col("document_identifier").alias("identifier"), "annotation", "sentiment")
    length = c.input.select("identifier", F.size(words(F.col("document"))).alias("n"))
    made = joined(union_votes(own), length).join(majority_sentiment(own), "identifier")
    return c.with_table("subphrases", made.select("identifier", F.col("identifier").alias("document_identifier"), "annotation", "sentiment"))


def nearest(tokens: DataFrame, offsets_: DataFrame) -> DataFrame:
    """tokens (identifier, start, ...) with the other columns of the row of offsets_ (identifier, start, ...) whose start is nearest,
    of two equally near the earlier.

    Both are put in one order of starts, where the nearest row is the last before or the first after, so no document's
    pairs are formed.  Tokens of documents without offsets are left out.
    """
    own, other = [c for c in tokens.columns if c not in ("identifier", "start")], [c for c in offsets_.columns if c not in ("identifier", "start")]
    none = lambda df, names: [F.lit(None).cast(df.schema[n].dataType).alias(f"_{k}{n}") for k, n in ((int(df is offsets_), n) for n in names)]
    a = tokens.select("identifier", "start", *(F.col(n).alias(f"_0{n}") for n in own), *none(offsets_, other), F.lit(None).cast("long").alias("_s"), F.lit(1).alias("_asked"))
    b = offsets_.select("identifier", "start", *none(tokens, own), *(F.col(n).alias(f"_1{n}") for n in other), F.col("start").cast("long").alias("_s"), F.lit(0).alias("_asked"))
    found = F.when(F.col("_s").isNotNull(), F.struct("_s", *(f"_1{n}" for n in other)))
    rows = a.unionByName(b).withColumn("_x", found)
    order = "PARTITION BY identifier ORDER BY start, _asked"
    rows = rows.withColumn("_before", F.expr(f"last(_x, true) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")).withColumn("_after", F.expr(f"first(_x, true) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"))
    near = F.when(F.col("_after").isNull() | (F.col("start") - F.col("_before._s") <= F.col("_after._s") - F.col("start")), F.col("_before")).otherwise(F.col("_after"))
    rows = rows.where("_asked = 1").withColumn("_near", near).where("_near IS NOT NULL")
    return rows.select("identifier", "start", *(F.col(f"_0{n}").alias(n) for n in own), *(F.col(f"_near._1{n}").alias(n) for n in other))


def _named(c: Corpus, name: str, prefix: str) -> str:
    """A table by its whole name, or by the part after its prefix."""
    return name if c.has(name) else prefix + name


@operator("MatchSubjectiveAnnotations", ("table",), ("subphrases_table", "src_table"))
def _match(c: Corpus, s: Spec) -> Corpus:
    """Votes of subphrases_table go to the tokens of table where the text is as in src_table."""
    off = _named(c, s.get("table"), "pos_off_")
    norm = _named(c, s.get("src_table", s.get("table").removeprefix("pos_off_")), "pos_norm_")
    sub = s.get("subphrases_table", "subphrases")
    return c.with_table(off, match_votes(c.input, c.dependent(_named(c, sub, "subphrases_")), c.dependent(norm), c.dependent(off)))
