"""Subjective-phrase annotators, their evaluation and cross validation.

An annotator gives (identifier, annotation: array<double>), a subjectivity for each word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from ..checkpoint import delete, durable, scratch
from ..corpus import Corpus
from ..functions.text import decile, letters_only, words
from ..registry import Spec, operator
from . import crf
from .annotations import _counted, _shares, beside, share_vectors, vectors, word_marks


def empirical(annotations: DataFrame) -> DataFrame:
    """The observed share of marks other than q at each position."""
    return share_vectors(annotations)


def word_rates(df: DataFrame, annotations: DataFrame) -> DataFrame:
    """word, rate: the share of a word's marks that aren't q, over all places and annotators; words in lower case."""
    rows = word_marks(df, annotations, "counts")
    return rows.groupBy("word").agg((F.sum("hits").cast("double") / F.sum("n")).alias("rate"))


def human(annotations: DataFrame) -> DataFrame:
    """The observed shares, each as its decile class stands for."""
    return empirical(annotations).select("identifier", F.transform("annotation", lambda p: class_value(decile(p))).alias("annotation"))


LITERAL = 1000  # scores that are looked up in a literal of the plan; more are joined


def fixed(df: DataFrame, entry: dict[str, float] | DataFrame, forward: dict[str, float] | DataFrame | None = None, legacy: bool = False) -> DataFrame:
    """Entry score of each word, plus the forward score of the word before.

    Words are those of the text's letters and blanks, empty ones left out, and are looked up as they are written.
    Scores are a dict, or a table (word, score) of any size.  Deviation: one entry for each
    word; legacy appends the words' entry scores once more.
    """
    letters = F.filter(words(letters_only(F.col("document"))), lambda w: w != "")
    if all(x is None or (isinstance(x, dict) and len(x) <= LITERAL) for x in (entry, forward)):
        rows = df.select("identifier", letters.alias("w"))
        of = lambda scores, w: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(scores.items()) for x in kv]), w), F.lit(0.0)) if scores else F.lit(0.0)
        rows = rows.select("identifier", F.transform("w", lambda w: of(entry, w)).alias("e"), F.transform("w", lambda w: of(forward, w)).alias("f"))
        moved = F.concat(F.array(F.lit(0.0)), "f")
        one = F.zip_with("e", F.slice(moved, F.lit(1), F.size("e")), lambda a, b: a + b)
        return rows.select("identifier", (F.concat(one, F.col("e")) if legacy else one).alias("annotation"))
    table = lambda x, name: (x if isinstance(x, DataFrame) else df.sparkSession.createDataFrame(sorted((x or {}).items()), "word string, score double")).select("word", F.col("score").alias(name))
    rows = df.select("identifier", F.posexplode(letters).alias("at", "word")).join(table(entry, "e"), "word", "left").join(table(forward, "f"), "word", "left").fillna(0.0, ["e", "f"])
    lists = rows.groupBy("identifier").agg(F.sort_array(F.collect_list(F.struct("at", "e", "f"))).alias("s"))
    moved = F.concat(F.array(F.lit(0.0)), "s.f")
    one = F.zip_with("s.e", F.slice(moved, F.lit(1), F.size("s")), lambda a, b: a + b)
    out = lists.select("identifier", (F.concat(one, F.col("s.e")) if legacy else one).alias("annotation"))
    return df.select("identifier").join(out, "identifier", "left").select("identifier", F.coalesce("annotation", F.array().cast("array<double>")).alias("annotation"))


CLASSES = 10  # deciles


def counted_words(text: Column) -> Column:
    """(at, word) of the space-split words that count, at being the place in the text.

    Empty words don't count, nor capitalised ones but for the first; words are in lower case, letters only, and
    those left empty don't count either.
    """
    kept = F.filter(F.transform(words(text), lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"] != "")
    kept = F.filter(kept, lambda x, j: (j == 0) | (F.lower(F.left(x["word"], F.lit(1))) == F.left(x["word"], F.lit(1))))
    return F.filter(F.transform(kept, lambda x: F.struct(x["at"].alias("at"), F.regexp_replace(F.lower(x["word"]), "[^a-z]", "").alias("word"))), lambda x: x["word"] != "")


def _clean(word: str) -> str:
    """A word's letters as ``counted_words`` has them."""
    return "".join(c for c in word.lower() if "a" <= c <= "z")


_LETTERS = np.zeros(256, np.uint8)  # what _clean makes of a byte of ASCII; 0 goes
_LETTERS[[*b"abcdefghijklmnopqrstuvwxyz"]] = _LETTERS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = [*b"abcdefghijklmnopqrstuvwxyz"]


def _cleaned(names: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(``_clean`` of words, whether a word's first character is as in lower case): from the bytes, but for words of other than ASCII."""
    whole = names.cast(pa.large_string())
    ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
    first = np.append(data, 0)[ends[:-1]]
    low = ~((first >= ord("A")) & (first <= ord("Z"))) | (np.diff(ends) == 0)
    data = data[ends[0] : ends[-1]] if len(ends) else data
    chars = _LETTERS[data]
    kept = np.concatenate([[0], np.cumsum(chars != 0)])[ends - ends[0]].astype(np.int32)
    clean = pa.StringArray.from_buffers(len(names), pa.py_buffer(kept), pa.py_buffer(chars[chars != 0]))
    odd = pc.not_equal(pc.binary_length(whole), pc.utf8_length(whole).cast(pa.int64()))
    if pc.any(odd).as_py():
        words_ = names.filter(odd).to_pylist()
        clean = pc.replace_with_mask(clean, odd, pa.array([_clean(w) for w in words_], pa.string()))
        low[odd.to_numpy(zero_copy_only=False)] = [w[:1].lower() == w[:1] for w in words_]
    return clean, low


def _split(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, place in it, number, distinct words) of the space-split words of texts."""
    lists = pc.split_pattern(texts, " ")
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(lists).dictionary_encode()
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), coded.indices.to_numpy(), coded.dictionary


def _counted_places(texts, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, place, number, words) of the counted words (``counted_words``) of texts at places before size, that of each row."""
    row, at, code, names = _split(texts)
    use = (pc.binary_length(names).to_numpy(zero_copy_only=False) > 0)[code]
    row, at, code = row[use], at[use], code[use]
    clean, low = _cleaned(names)
    coded = clean.dictionary_encode()
    number = coded.indices.to_numpy().astype(np.int64)[code]
    use = (low[code] | (np.diff(row, prepend=-1) != 0)) & (number != pc.index(coded.dictionary, "").as_py())
    row, at, number = row[use], at[use], number[use]
    use = at < size[row]
    return row[use], at[use], number[use], coded.dictionary


def _labelled(text: str, shares: str) -> Column:
    """(at, word, share) of each text's counted words that have a share (``counted_words``), by Arrow batches."""

    def run(texts, lists):
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        row, at, number, known = _counted_places(texts, size)
        share = pc.list_flatten(lists).take(pa.array((np.cumsum(size) - size)[row] + at))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]).astype(np.int32)
        made = pa.StructArray.from_arrays([pa.array(at, pa.int32()), known.take(pa.array(number)), share], names=["at", "word", "share"])
        return pa.ListArray.from_arrays(pa.array(ends), made)

    return F.arrow_udf(run, "array<struct<at:int,word:string,share:double>>", ArrowUDFType.SCALAR)(text, shares)


def _classes(texts: pa.ListArray, annotations: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, place, number, class, words) of the counted words of rows' texts that have a mark, with the class of ``decile``."""
    size, m = _counted(annotations)
    own = pc.list_parent_indices(texts).to_numpy()
    text, at, number, known = _counted_places(pc.list_flatten(texts), size[own])
    row = own[text]
    class_ = np.maximum(np.floor((_shares(m) - 0.001) * 10), 0).astype(np.int32)
    return row, at, number, class_[(np.cumsum(size) - size)[row] + at], known


def marked_words(df: DataFrame, annotations: DataFrame) -> DataFrame:
    """``labelled_words`` of the shares of annotations (identifier, annotation), whose strings meet the texts in one group."""

    def run(ids, texts, lists):
        row, at, number, class_, known = _classes(texts, lists)
        columns = [ids.take(pa.array(row)), pa.array(at, pa.int32()), known.take(pa.array(number)), pa.array(class_)]
        return pa.RecordBatch.from_arrays(columns, names=["identifier", "at", "word", "class"])

    return beside(df, annotations, F.col("document"), run, f"identifier {df.schema['identifier'].dataType.simpleString()}, at int, word string, class int")


def class_counts(df: DataFrame, annotations: DataFrame) -> DataFrame:
    """word, class, n: how often a counted word has a class (``marked_words``), summed over documents of a batch."""

    def run(ids, texts, lists):
        _, _, number, class_, known = _classes(texts, lists)
        keys, n = np.unique(number * CLASSES + class_, return_counts=True)
        columns = [known.take(pa.array(keys // CLASSES)), pa.array((keys % CLASSES).astype(np.int32)), pa.array(n)]
        return pa.RecordBatch.from_arrays(columns, names=["word", "class", "n"])

    return beside(df, annotations, F.col("document"), run, "word string, class int, n long")


def labelled_words(df: DataFrame, shares: DataFrame) -> DataFrame:
    """identifier, at, word, class: counted words with the decile class of the share at their place in the text.

    shares: a row a document (identifier, annotation), or one a position (identifier, at, share).
    """
    if "annotation" in shares.columns:
        rows = df.select("identifier", "document").join(shares.select("identifier", "annotation"), "identifier")
        return rows.select("identifier", F.inline(_labelled("document", "annotation"))).select("identifier", "at", "word", decile(F.col("share")).alias("class"))
    rows = df.select("identifier", F.inline(counted_words(F.col("document"))))
    return rows.join(shares, ["identifier", "at"]).select("identifier", "at", "word", decile(F.col("share")).alias("class"))


def bayes_table(words_: DataFrame) -> DataFrame:
    """word, class, score: P(word | class) / P(class), the class of greatest score (ties to the smaller).

    words_ has a row for each occurrence, or counts n of them.  The denominators come from two aggregates, the second over ten classes.
    """
    n = durable(words_.groupBy("word", "class").agg((F.sum("n") if "n" in words_.columns else F.count("*")).alias("n")))  # read twice
    per_class = n.groupBy("class").agg(F.sum("n").alias("nc"))
    scale = per_class.withColumn("t", F.expr("sum(nc) OVER ()"))  # ten rows
    scored = n.join(F.broadcast(scale), "class").withColumn("score", (F.col("n").cast("double") / F.col("nc")) / (F.col("nc").cast("double") / F.col("t")))
    best = scored.groupBy("word").agg(F.min(F.struct((-F.col("score")).alias("o"), F.col("class").alias("c"))).alias("b"))
    return best.select("word", F.col("b.c").alias("class"), (-F.col("b.o")).alias("score"))


def class_value(c: Column) -> Column:
    """The share that a decile class stands for, a tenth of it."""
    return c.cast("double") / 10


def bayesian(df: DataFrame, table: DataFrame) -> DataFrame:
    """The class value of each counted word; words not in the table are 0, and a text without such words is one 0."""
    rows = df.select("identifier", F.posexplode(counted_words(F.col("document"))).alias("at", "x")).select("identifier", "at", "x.word")
    scored = rows.join(table.select("word", "class"), "word", "left").select("identifier", "at", F.coalesce(class_value(F.col("class")), F.lit(0.0)).alias("share"))
    return df.select("identifier").join(vectors(scored), "identifier", "left").select("identifier", F.coalesce("annotation", F.array(F.lit(0.0))).alias("annotation"))


def markov_model(words_: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """(log transitions of START, 0..9, END; (word, class, log emission)) with add-one smoothing of transitions."""
    nxt, prv = F.lead("class").over(_by_position()), F.lag("class").over(_by_position())
    each = words_.select(F.coalesce(prv, F.lit(-1)).alias("a"), F.col("class").alias("b"), nxt.isNull().alias("last"))
    n = np.ones((CLASSES + 2, CLASSES + 2))
    for r in each.groupBy("a", "b", "last").agg(F.count("*").alias("n")).collect():  # 220 rows at most
        n[r["a"] + 1, r["b"] + 1] += r["n"]
        if r["last"]:
            n[r["b"] + 1, CLASSES + 1] += r["n"]
    emission = durable(words_.groupBy("class", "word").agg(F.count("*").alias("n")))
    sums = emission.groupBy("class").agg(F.sum("n").alias("t"))
    emission = emission.join(F.broadcast(sums), "class").select("word", "class", F.log(F.col("n") / F.col("t")).alias("e"))
    return np.log(n / n.sum(1, keepdims=True)), emission


def _by_position():
    from pyspark.sql import Window

    return Window.partitionBy("identifier").orderBy("at")


def viterbi(trans: np.ndarray, emissions: np.ndarray) -> list[int]:
    """The most likely classes of a sequence; emissions: (n, CLASSES) logs.  Ties go to the smaller class."""
    n = len(emissions)
    if not n:
        return []
    score = trans[0, 1 : CLASSES + 1] + emissions[0]
    back = []
    for k in range(1, n):
        step = score[:, None] + trans[1 : CLASSES + 1, 1 : CLASSES + 1]
        back.append(step.argmax(0))
        score = step.max(0) + emissions[k]
    at = int((score + trans[1 : CLASSES + 1, CLASSES + 1]).argmax())
    out = [at]
    for b in reversed(back):
        at = int(b[at])
        out.append(at)
    return out[::-1]


def viterbi_many(trans: np.ndarray, emissions: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``viterbi`` of many sequences, one after the other in emissions, walked one position of all of them at a time."""
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    longest, falling = int(sizes.max(initial=0)), -sizes[order]
    score, back = np.array(emissions), np.zeros(emissions.shape, np.int8)
    inner = trans[1 : CLASSES + 1, 1 : CLASSES + 1]
    at = lambda t: begin[order[: int(np.searchsorted(falling, -t, side="left"))]] + t
    score[at(0)] += trans[0, 1 : CLASSES + 1]
    for t in range(1, longest):
        here = at(t)
        step = score[here - 1][:, :, None] + inner
        back[here] = step.argmax(1)
        score[here] += step.max(1)
    out = np.zeros(len(emissions), np.int64)
    ends = (begin + sizes - 1)[order]
    out[ends] = (score[ends] + trans[1 : CLASSES + 1, CLASSES + 1]).argmax(1)
    for t in range(longest - 1, 0, -1):
        here = at(t)
        out[here - 1] = back[here, out[here]]
    return out


COMMON = 200_000  # words whose emissions are sent to the tasks; those of others are joined


def markov(df: DataFrame, model: tuple[np.ndarray, DataFrame], unseen: float = -12.0, common: int = COMMON) -> DataFrame:
    """Viterbi decoding of each document's words; one value for each word.

    Emissions of up to ``common`` words, those likeliest in any class, go to every task.  Those of other words are
    joined to the documents that hold them, each word of a document once, so what is shuffled is the rare words only.
    """
    trans, emission = model
    spark = df.sparkSession
    with scratch() as keep:
        pairs_ = F.sort_array(F.collect_list(F.struct(F.col("class").cast("int").alias("c"), "e")))
        table = keep(durable(emission.groupBy("word").agg(pairs_.alias("e"), F.max("e").alias("top"))))  # ten entries at most
        words_, cut = 0, float("inf")
        steps = table.groupBy(F.floor(F.col("top") * 8).alias("b")).count().orderBy(F.desc("b")).collect()  # logs of counts: a few hundred
        for r in steps:
            words_ += r["count"]
            cut = r["b"] if words_ <= common else cut
        first = table.where(F.floor(F.col("top") * 8) >= cut).select("word", "e").toArrow()
        own = _Emissions(first.column("word").combine_chunks(), *_full(first.column("e").combine_chunks(), unseen))
        sent = spark.sparkContext.broadcast(own)

        def rare(texts):
            row, _, code, names = _split(texts)
            clean, _ = _cleaned(names)
            coded = clean.dictionary_encode()
            strange = pc.is_null(sent.value.find(coded.dictionary)).to_numpy(zero_copy_only=False)
            number = coded.indices.to_numpy()[code] if len(clean) else code
            keys = np.unique((row * max(1, len(strange)) + number)[strange[number]]) if len(number) else number
            ends = np.concatenate([[0], np.cumsum(np.bincount(keys // max(1, len(strange)), minlength=len(texts)))]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), coded.dictionary.take(pa.array(keys % max(1, len(strange)))))

        texts = df.select("identifier", "document").where("document IS NOT NULL")
        if words_ > len(first):
            strange = texts.select("identifier", F.explode(F.arrow_udf(rare, "array<string>", ArrowUDFType.SCALAR)("document")).alias("word")).distinct()
            found = strange.join(table.select("word", "e"), "word").groupBy("identifier").agg(F.collect_list(F.struct("word", "e")).alias("x"))
            held = texts.join(found, "identifier", "left")
        else:
            held = texts.withColumn("x", F.lit(None).cast("array<struct<word:string,e:array<struct<c:int,e:double>>>>"))

        def decode(it):
            known = sent.value
            for batch in it:
                out, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
                end = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
                lo, hi = 0, 0
                while hi < batch.num_rows:
                    lo, hi = hi, max(hi + 1, int(np.searchsorted(end, TEXTS + (end[hi - 1] if hi else 0), side="right")))
                    part = batch.slice(lo, hi - lo)
                    row, _, code, names = _split(part.column(1))
                    clean, _ = _cleaned(names)
                    place = pc.fill_null(known.find(clean), len(known.words)).to_numpy(zero_copy_only=False).astype(np.int64)
                    e = known.scores[place[code]]
                    extra = part.column(2)
                    if len(extra) > extra.null_count:
                        items = pc.list_flatten(extra)
                        coded = pa.chunked_array([clean, items.field("word")]).combine_chunks().dictionary_encode()
                        width = max(1, len(coded.dictionary))
                        numbers = coded.indices.to_numpy()
                        have = pc.list_parent_indices(extra).to_numpy() * width + numbers[len(clean) :]
                        order = np.argsort(have)
                        want = row * width + numbers[: len(clean)][code]
                        spot = np.minimum(np.searchsorted(have[order], want), len(have) - 1)
                        hit = have[order][spot] == want
                        e[hit] = _full(items.field("e"), unseen)[0][order[spot[hit]]]
                    n = np.bincount(row, minlength=part.num_rows)
                    out.append(viterbi_many(trans, e, n) / 10)
                    sizes.append(n)
                ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out)))], names=["identifier", "annotation"])

        return durable(held.select("identifier", "document", "x").mapInArrow(decode, "identifier long, annotation array<double>"))


TEXTS = 1 << 20  # bytes of texts that are decoded at a time


def _full(lists: pa.ListArray, unseen: float) -> tuple[np.ndarray]:
    """Emissions of all classes, and of an unseen word after the last, from lists of (class, emission)."""
    out = np.full((len(lists) + 1, CLASSES), unseen)
    items = pc.list_flatten(lists)
    out[pc.list_parent_indices(lists).to_numpy(), items.field("c").to_numpy()] = items.field("e").to_numpy()
    return (out,)


class _Emissions:
    """Words and the emissions of each; the last row is that of an unseen word."""

    def __init__(self, words_: pa.Array, scores: np.ndarray):
        self.words, self.scores = words_, scores

    def find(self, asked: pa.Array) -> pa.Array:
        return pc.index_in(asked, value_set=self.words)


def _error(predicted: DataFrame, observed: DataFrame, of) -> DataFrame:
    """identifier, error: the sum over positions of ``of`` the difference, where a missing value is 0.

    A row for each pair of a predicted and an observed vector of one document; documents without either have none.
    """
    both = predicted.select("identifier", F.col("annotation").alias("p")).join(observed.select("identifier", F.col("annotation").alias("o")), "identifier")
    none = F.array().cast("array<double>")
    steps = F.zip_with(F.coalesce("p", none), F.coalesce("o", none), lambda p, o: of(F.coalesce(p, F.lit(0.0)) - F.coalesce(o, F.lit(0.0))))
    return both.select("identifier", F.aggregate(steps, F.lit(0.0), lambda a, x: a + x).alias("error"))


def squared_error(predicted: DataFrame, observed: DataFrame) -> DataFrame:
    """identifier, error: the sum of squared differences over positions; a missing one is 0."""
    return _error(predicted, observed, lambda d: d * d)


def absolute_error(predicted: DataFrame, observed: DataFrame) -> DataFrame:
    return _error(predicted, observed, F.abs)


def fold(identifier: Column, folds: int, seed: int = 0) -> Column:
    """0 .. folds-1 by a hash that any SQL can compute."""
    return (F.shiftright(F.pmod(identifier + seed, F.lit(1_000_003)) * F.lit(2654435761), 16) % folds).cast("int")


def cross_validate(df: DataFrame, annotations: DataFrame, train_and_tag, folds: int = 10, seed: int = 0) -> DataFrame:
    """fold, error: summed squared error of train_and_tag(train docs, their annotations, test docs)."""
    out = None
    dealt = df.withColumn("_fold", fold(F.col("identifier"), folds, seed))
    marks = annotations.withColumn("_fold", fold(F.col("identifier"), folds, seed))
    for k in range(folds):
        test = dealt.where(F.col("_fold") == k)
        predicted = train_and_tag(dealt.where(F.col("_fold") != k), marks.where(F.col("_fold") != k), test)
        error = squared_error(predicted, empirical(marks.where(F.col("_fold") == k))).agg(F.coalesce(F.sum("error"), F.lit(0.0)).alias("error")).select(F.lit(k).alias("fold"), "error")
        out = error if out is None else out.union(error)
    return out


def _runs(field: str, longest: int, first: int = -2, last: int = 2) -> list[tuple[tuple[str, int], ...]]:
    """All runs of up to ``longest`` neighbouring offsets."""
    return [tuple((field, k + j) for j in range(n)) for n in range(1, longest + 1) for k in range(first, last - n + 2)]


#: attribute templates: words at offsets -2 to 2 and pairs with the word itself; tags alone, in pairs and in threes
WORD_TEMPLATES = [*_runs("w", 1), *(t for t in _runs("w", 2) if len(t) == 2 and ("w", 0) in t)]
TAG_TEMPLATES = _runs("pos", 3)


def context_features(df: DataFrame, tags: str | None = None) -> DataFrame:
    """identifier, at, features: the attributes of each word by the templates, and marks of both ends.

    tags: an array column of a tag for each space-split word; without it only words are looked at.
    """
    from pyspark.sql import Window

    split = words(F.col("document"))
    rows = df.select("identifier", F.posexplode(F.arrays_zip(split.alias("w"), F.col(tags).alias("pos"))).alias("at", "x")).select("identifier", "at", "x.w", "x.pos") if tags else df.select("identifier", F.posexplode(split).alias("at", "w"))
    near = Window.partitionBy("identifier").orderBy("at")
    templates = [*WORD_TEMPLATES, *(TAG_TEMPLATES if tags else [])]
    spot = {x: F.col(x[0]) if not x[1] else F.lag(x[0], -x[1]).over(near) if x[1] < 0 else F.lead(x[0], x[1]).over(near) for t in templates for x in t}
    name = lambda t: "|".join(f"{f}[{k}]" for f, k in t) + "="
    made = [F.concat(F.lit(name(t)), *[y for k, x in enumerate(t) for y in ([F.lit("|")] if k else []) + [spot[x]]]) for t in templates]
    ends = [F.when(F.lag("at").over(near).isNull(), F.lit("__BOS__")), F.when(F.lead("at").over(near).isNull(), F.lit("__EOS__"))]
    return rows.select("identifier", "at", F.array_compact(F.array(*made, *ends)).alias("features"))


def _parts(c: Corpus, s: Spec) -> tuple[DataFrame, DataFrame, str]:
    """(documents to tag, annotations to learn from, table to write); DataFlow names the files that either comes from."""
    marks = c.dependent("subphrases").select(F.col("document_identifier").alias("identifier"), "annotation")
    flow = s.all("DataFlow")
    docs = c.input
    if flow and c.has("label_amt"):
        names = c.table("label_names_amt").select(F.col("label_identifier").alias("label"), F.col("label").alias("_l"))
        bridge = c.table("label_amt").join(names, "label").select(F.col("document_identifier").alias("identifier"), "_l")
        source = [x.get("text") for f in flow for x in f.all("Source")]
        target = [x.get("text") for f in flow for x in f.all("Target")]
        if source:
            marks = marks.join(bridge.where(F.col("_l").isin(source)), "identifier", "left_semi")
        if target:
            docs = docs.join(bridge.where(F.col("_l").isin(target)), "identifier", "left_semi")
    return docs, marks, f"subphrases_{s.get('outputTable')}"


#: further attributes that workflows give: normalisation, and files of a sequence trainer of its own, which none is here
NORMALISING = ("useSentiWordNet", "useMQPA", "normalisingRExp", "normaliseCase", "stemmer", "lemmatise", "stopWords", "stopPos", "lesk", "min", "max", "trainPath", "testPath", "train_path", "test_path", "results_path")


def _annotator(name: str, make, *optional: str):
    @operator(name, ("outputTable",), (*optional, *NORMALISING))
    def run(c: Corpus, s: Spec) -> Corpus:
        docs, marks, table = _parts(c, s)
        made = make(c, s, docs, marks)
        return c.with_table(table, made.select("identifier", F.col("identifier").alias("document_identifier"), "annotation"))

    return run


_annotator("EmpiricalSubjectivePhraseAnnotator", lambda c, s, d, m: empirical(m).join(d.select("identifier"), "identifier", "left_semi"))
_annotator("HumanBasedSubjectivePhraseAnnotator", lambda c, s, d, m: human(m).join(d.select("identifier"), "identifier", "left_semi"))
_annotator(
    "FixedSubjectivePhraseAnnotator",
    lambda c, s, d, m: fixed(
        d,
        {w.get("string"): w.get("prob", 0.0, float) for e in s.all("EntryNodes") for w in e.all("Word")},
        {w.get("string"): w.get("prob", 0.0, float) for e in s.all("ForwardTransitionNodes") for w in e.all("Word")},
        s.get("legacy", False, bool),
    ),
    "legacy",
)
_annotator("NLTKSubjectivePhraseBayesianAnnotator", lambda c, s, d, m: bayesian(d, bayes_table(class_counts(c.input, m))))
_annotator("NLTKSubjectivePhraseMarkovAnnotator", lambda c, s, d, m: markov(d, markov_model(marked_words(c.input, m))))
_annotator("CRFSubjectiveAnnotator", lambda c, s, d, m: crf_annotation(d, crf_model(c.input, m)))


@operator("ProduceCRFSTagList", ("train_path", "test_path"), ("results_path",))
def _tag_list(c: Corpus, s: Spec) -> Corpus:
    """Learn from a file of tagged sequences (word, tag, class to a line) and tag those of another: tag_list has the names of the
    classes (annotation) and their marginal probabilities; results_path gets a line for each word, and one after each sequence."""
    from ..sources.corpora import sequences

    with scratch() as keep:

        def rows(path: str) -> DataFrame:
            found = keep(durable(sequences(c.spark, path).withColumn("identifier", F.monotonically_increasing_id())))
            w = F.transform("items", lambda x: F.coalesce(x["w"], F.lit("")))
            return found.select("identifier", crf.text_features(w, F.transform("items", lambda x: x["pos"])).alias("features"), F.transform("items", lambda x: x["y"]).alias("y"))

        known = crf.train(rows(s.get("train_path")))
        made = durable(crf.tag(rows(s.get("test_path")).drop("y"), known).select("identifier", F.col("y").alias("annotation"), "p"))
    if s.get("results_path"):
        made.select(F.concat(F.array_join("annotation", "\n"), F.lit("\n")).alias("value")).write.mode("overwrite").text(s.get("results_path"))
    return c.with_table("tag_list", made)


def crf_rows(df: DataFrame, marks: DataFrame) -> DataFrame:
    """identifier, features, y: the space-split words of annotated texts, and the decile classes of their shares."""
    split = words(F.col("document"))
    both = df.select("identifier", "document").join(share_vectors(marks), "identifier")  # texts are dealt, not their attributes
    return both.select("identifier", crf.text_features(split).alias("features"), F.transform("annotation", lambda p: decile(p).cast("string")).alias("y"))


def crf_model(df: DataFrame, marks: DataFrame) -> crf.Model:
    return crf.train(crf_rows(df, marks))


def crf_annotation(df: DataFrame, model: crf.Model) -> DataFrame:
    """identifier, annotation: what the most likely class of each word stands for; 0 without a class."""
    found = crf.tag(df.select("identifier", crf.text_features(words(F.col("document"))).alias("features")), model)
    return found.select("identifier", F.transform("y", lambda c: F.coalesce(class_value(c.try_cast("int")), F.lit(0.0))).alias("annotation"))


def agreement(predicted: DataFrame, observed: DataFrame) -> DataFrame:
    """One row: counts of words that are (not) subjective by both or either, precision, recall and F; half and more is subjective."""
    from .results import confusion

    both = predicted.select("identifier", F.col("annotation").alias("p")).join(observed.select("identifier", F.col("annotation").alias("o")), "identifier")
    # words of one place in both lists; the longer list goes on without a partner
    rows = both.where("p IS NOT NULL AND o IS NOT NULL").select(F.least(F.size("p"), F.size("o")).alias("n"), "p", "o").select(F.inline(F.arrays_zip(F.slice("p", F.lit(1), F.col("n")).alias("p"), F.slice("o", F.lit(1), F.col("n")).alias("o"))))
    return confusion(rows.select((F.col("o") >= 0.5).cast("int").alias("y"), (F.col("p") >= 0.5).cast("int").alias("z")), "y", "z")


def _subjective(marks: DataFrame) -> DataFrame:
    """identifier, annotation, p: s where over half of the marks are subjective, else q; and the share of such marks."""
    shares = share_vectors(marks)
    return shares.select("identifier", F.transform("annotation", lambda p: F.when(p > 0.5, "s").otherwise("q")).alias("annotation"), F.col("annotation").alias("p"))


def _tag_rows(df: DataFrame) -> DataFrame:
    return df.select("identifier", crf.text_features(words(F.col("document"))).alias("features"))


def subjectivity_model(df: DataFrame, marks: DataFrame) -> crf.Model:
    """A field of two classes, s and q, of the majority of a document's annotations at each word."""
    both = df.select("identifier", "document").join(_subjective(marks).select("identifier", F.col("annotation").alias("y")), "identifier")
    return crf.train(both.select("identifier", crf.text_features(words(F.col("document"))).alias("features"), "y"))


@operator("CRFSubjectivityTagger", ("mode",), ("resultsPath", "modelPath", "subphrase_src", "subphraseDest"))
def _tagger(c: Corpus, s: Spec) -> Corpus:
    """train: learn s and q from subphrase_src and keep the model at modelPath.  tag: by that model, the probability of s into
    subphraseDest.  evaluate: learn from even folds, tag odd ones, and write their agreement to resultsPath."""
    from ..sources.sinks import write_csv

    chance = lambda found: found.select("identifier", F.zip_with("y", "p", lambda y, p: F.when(y == "s", p).otherwise(1 - p)).alias("annotation"))
    marks = c.dependent(s.get("subphrase_src", "subphrases")).select(F.col("document_identifier").alias("identifier"), "annotation")
    mode = s.get("mode")
    if mode == "train":
        crf.save_model(c.spark, subjectivity_model(c.input, marks), s.get("modelPath"))
        return c
    if mode == "tag":
        made = chance(crf.tag(_tag_rows(c.input), crf.load_model(c.spark, s.get("modelPath"))))
        return c.with_table(f"subphrases_{s.get('subphraseDest')}", made.select("identifier", F.col("identifier").alias("document_identifier"), "annotation"))
    if mode != "evaluate":
        raise ValueError(f"no mode {mode}; there are train, tag, evaluate")
    made = tagger_agreement(c.input, marks)
    if s.get("resultsPath"):
        write_csv(made, s.get("resultsPath"))
    return c.with_table("agreement", made)


def tagger_agreement(df: DataFrame, marks: DataFrame) -> DataFrame:
    """Agreement of the subjectivity tagger, learnt from even folds, with the majority of the annotations of odd ones."""
    test = fold(F.col("identifier"), 10) % 2 == 1
    model = subjectivity_model(df.where(~test), marks.where(~test))
    number = lambda found, name: found.select("identifier", F.transform(name, lambda y: (y == "s").cast("double")).alias("annotation"))
    return agreement(number(crf.tag(_tag_rows(df.where(test)), model), "y"), number(_subjective(marks.where(test)), "annotation"))


POOL = 10  # genomes that compete
FEW_KEYS = 1_000_000  # words and pairs whose scores are broadcast


def evolution_pairs(df: DataFrame) -> DataFrame:
    """identifier, at, i, j, ij: neighbouring words of each text, normalised, and their pair as one key."""
    from .normalise import evolution_words

    rows = _neighbours(df.select("identifier", evolution_words(F.col("document")).alias("w")))
    return rows.select("identifier", "at", "i", "j", F.concat_ws(" ", "i", "j").alias("ij"))


def _neighbours(rows: DataFrame) -> DataFrame:
    """identifier, at, i, j, and with shares a, the class values a1 and a2 of the words that have one, of neighbouring words w."""
    n = F.greatest(F.size("w") - 1, F.lit(0))
    names = {"i": "w", "j": "w"} | ({"a1": "a", "a2": "a"} if "a" in rows.columns else {})
    late = {"j", "a2"}
    both = F.arrays_zip(*(F.slice(c, F.lit(2 if k in late else 1), n).alias(k) for k, c in names.items()))
    out = rows.select("identifier", F.posexplode(both).alias("at", "x")).select("identifier", "at", *(F.col("x")[k].alias(k) for k in names))
    return out.where("a1 IS NOT NULL AND a2 IS NOT NULL") if "a" in rows.columns else out


def evolution_targets(pairs_: DataFrame, shares: DataFrame) -> DataFrame:
    """pairs_ with a1 and a2, a tenth of the decile class that either word was given."""
    one = shares.select("identifier", "at", class_value(decile(F.col("share"))).alias("a"))
    left = pairs_.join(one.withColumnRenamed("a", "a1"), ["identifier", "at"])
    return left.join(one.select("identifier", (F.col("at") - 1).alias("at"), F.col("a").alias("a2")), ["identifier", "at"])


def evolution_sums(df: DataFrame, annotations: DataFrame) -> DataFrame:
    """ij, i, j, n, s1, s2, t, tt of each pair of neighbouring words of annotated texts: how often it occurs, the sums of the class values
    that its words were given, and of their means and the squares of those.  The error of a score over all texts follows from these.

    Pairs of a batch of texts are summed before they are rows, as whole numbers of classes, so sums don't depend on their order.
    """
    from .normalise import evolution_word

    def run(ids, texts, lists):
        size, m = _counted(lists)
        class_ = np.maximum(np.floor((_shares(m) - 0.001) * 10), 0).astype(np.int64)
        text, at, code, names = _split(pc.list_flatten(texts))
        row = pc.list_parent_indices(texts).to_numpy()[text]
        coded = pa.array([evolution_word(w) for w in names.to_pylist()], pa.string()).dictionary_encode()
        number, known = coded.indices.to_numpy().astype(np.int64)[code], coded.dictionary
        left = np.flatnonzero((text[1:] == text[:-1]) & (at[1:] < size[row[1:]]))
        place = (np.cumsum(size) - size)[row[left]] + at[left]
        a, b = class_[place], class_[place + 1]
        keys, own, n = np.unique(number[left] * len(known) + number[left + 1], return_inverse=True, return_counts=True)
        sums = [np.bincount(own, x, len(keys)).astype(np.int64) for x in (a, b, a + b, (a + b) ** 2)]
        columns = [known.take(pa.array(keys // max(1, len(known)))), known.take(pa.array(keys % max(1, len(known)))), pa.array(n.astype(np.int64)), *map(pa.array, sums)]
        return pa.RecordBatch.from_arrays(columns, names=["i", "j", "n", "a", "b", "c", "cc"])

    rows = beside(df, annotations, F.col("document"), run, "i string, j string, n long, a long, b long, c long, cc long")
    found = rows.groupBy("i", "j").agg(*(F.sum(x).alias(x) for x in ("n", "a", "b", "c", "cc")))
    return found.select(F.concat_ws(" ", "i", "j").alias("ij"), "i", "j", "n", *((F.col(x) / k).alias(y) for x, k, y in (("a", 10, "s1"), ("b", 10, "s2"), ("c", 20, "t"), ("cc", 400, "tt"))))


def _settled(sums: DataFrame, words_: DataFrame) -> DataFrame:
    """key, n, score of the least error: words have their means m, a pair what is left for the pair's score to be its own mean.

    A pair's score is its own alone, so each pair's error is as small as any score can make it, whatever its words have.
    """
    rows = sums.select("ij", "i", "j", "n", "t")
    few = words_.count() <= FEW_KEYS
    for x in ("i", "j"):
        table = words_.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("m").alias(f"m_{x}"))
        rows = rows.join(F.broadcast(table) if few else table, x)
    mean = F.col("t") / F.col("n")
    rest = F.col("n_i") * (mean - F.col("m_i")) + F.col("n_j") * (mean - F.col("m_j"))
    return words_.select("key", "n", F.col("m").alias("score")).union(rows.select("ij", "n", mean + rest / F.col("n")))


def _scores(rows: DataFrame, genome: DataFrame, few: bool, size: int, names: tuple[str, ...] = ("ij", "i", "j")) -> DataFrame:
    """rows with s: for each of size genomes the mean of a pair's and its words' scores, weighted by how often each was seen.

    genome: (key, n, g: array of scores); of names, those that aren't joined are columns of rows.  Keys that were never seen have no weight.
    """
    for name in names:
        table = genome.select(F.col("key").alias(name), F.col("n").alias(f"n_{name}"), F.col("g").alias(f"g_{name}"))
        rows = rows.join(F.broadcast(table) if few else table, name, "left")
    weight = sum((F.coalesce(f"n_{x}", F.lit(0)) for x in ("i", "j")), F.coalesce("n_ij", F.lit(0)))
    part = lambda x, k: F.coalesce(F.col(f"n_{x}") * F.get(F.col(f"g_{x}"), F.lit(k)), F.lit(0.0))
    return rows.withColumn("s", F.array(*(F.when(weight > 0, (part("ij", k) + part("i", k) + part("j", k)) / weight).otherwise(0.0) for k in range(size))))


def evolve(df: DataFrame, annotations: DataFrame, generations: int | None = None, spread: float = 0.005, seed: int = 0) -> DataFrame:
    """key, n, score: a score for every word and every pair of neighbours, of the least summed squared error of the pairs of
    all annotated texts; with a number of generations, what a genetic search has found by then.

    Without a number the search is over, whatever its spread, when no genome can have a smaller error, and those scores are
    given as they are (``_settled``).  Rounds don't get there: a child with one in twenty of many scores changed is hardly ever better.

    The first genome has the mean annotation of each key; others start as mutations of it.  A child takes each score
    from either of two parents, and one in twenty is changed by up to 0.2; it takes the place of the worst genome if its error
    is at most the mean one.  The search ends once the errors of the pool are within spread, or after the given
    generations of ``POOL`` children.  The texts are read once, for the sums of each distinct pair.  Genomes are columns of two tables,
    of pairs with their sums and of words; what is random in a key comes from hashes, so a
    generation joins the words to the distinct pairs, and only errors come to the driver.
    """
    uniform = lambda tag: F.pmod(F.xxhash64("key", F.lit(f"{seed} {tag}")), F.lit(1 << 40)).cast("double") / float(1 << 40)
    mutated = lambda score, tag: score + F.when(uniform(f"{tag} which") < 0.05, 0.4 * uniform(f"{tag} by") - 0.2).otherwise(0.0)
    first = F.array(F.col("m"), *(mutated(F.col("m"), f"start {k}") for k in range(1, POOL))).alias("g")
    with scratch() as keep:
        sums = keep(durable(evolution_sums(df, annotations)))
        ends = sums.select(F.col("i").alias("key"), "n", F.col("s1").alias("a")).union(sums.select("j", "n", "s2"))
        means = ends.groupBy("key").agg(F.sum("n").alias("n"), (F.sum("a") / F.sum("n")).alias("m"))
        if generations is None:
            return durable(_settled(sums, keep(durable(means))))
        words_ = durable(means.select("key", "n", first))
        pairs_ = durable(sums.select(F.col("ij").alias("key"), "i", "j", "n", "t", "tt", (F.col("t") / F.col("n")).alias("m")).select("key", "i", "j", "n", "t", "tt", first))
        held = [words_, pairs_]
        few = words_.count() <= FEW_KEYS

        def errors(words_: DataFrame, pairs_: DataFrame, size: int) -> list[float]:
            rows = pairs_.select("i", "j", "n", "t", "tt", F.col("n").alias("n_ij"), F.col("g").alias("g_ij"))
            scored = _scores(rows, words_, few, size, ("i", "j"))
            each = [F.coalesce(F.sum(F.col("n") * F.col("s")[k] * F.col("s")[k] - 2 * F.col("s")[k] * F.col("t") + F.col("tt")), F.lit(0.0)).alias(f"e{k}") for k in range(size)]
            return list(scored.agg(*each).first())

        value = errors(words_, pairs_, POOL)
        rng = np.random.default_rng(seed)
        for generation in range(generations):
            if max(value) - min(value) < spread:
                break
            parents = rng.integers(0, POOL, (POOL, 2))
            child = lambda c: mutated(F.when(uniform(f"{generation} {c}") < 0.5, F.get("g", F.lit(int(parents[c][0])))).otherwise(F.get("g", F.lit(int(parents[c][1])))), f"{generation} {c}")  # noqa: E731, B023
            before = held
            held = [durable(x.withColumn("g", F.concat("g", F.array(*(child(c) for c in range(POOL)))))) for x in (words_, pairs_)]
            for x in before:
                delete(x)
            young = errors(*(x.withColumn("g", F.slice("g", POOL + 1, POOL)) for x in held), POOL)
            place = list(range(POOL))
            for c, e in enumerate(young):
                if e <= sum(value) / POOL:
                    worst = int(np.argmax(value))
                    place[worst], value[worst] = POOL + c, e
            words_, pairs_ = (x.withColumn("g", F.array(*(F.get("g", F.lit(p)) for p in place))) for x in held)
        score = F.get("g", F.lit(int(np.argmin(value)))).alias("score")
        out = durable(words_.select("key", "n", score).union(pairs_.select("key", "n", score)))
        for x in held:
            delete(x)
    return out


def evolved(df: DataFrame, scores: DataFrame) -> DataFrame:
    """identifier, annotation: each word has the score of the pair that it begins, the last word that of the one it ends;
    a text of one word has a zero."""
    few = scores.count() <= FEW_KEYS
    made = _scores(evolution_pairs(df), scores.select("key", "n", F.array("score").alias("g")), few, 1).select("identifier", "at", F.col("s")[0].alias("share"))
    lists = vectors(made).select("identifier", F.concat("annotation", F.array(F.element_at("annotation", -1))).alias("annotation"))
    return df.select("identifier").join(lists, "identifier", "left").select("identifier", F.coalesce("annotation", F.array(F.lit(0.0))).alias("annotation"))


_annotator("SubjectiveEvolution", lambda c, s, d, m: evolved(d, evolve(c.input, m, s.get("generations", None, int), seed=s.get("seed", 0, int))), "seed", "generations")


@operator("SubjectiveAnnotationEvaluator", ("sourceTable", "predictedTable", "bucket"), ("metric",))
def _evaluate(c: Corpus, s: Spec) -> Corpus:
    observed = empirical(c.dependent("subphrases").select(F.col("document_identifier").alias("identifier"), "annotation")) if s.get("sourceTable") == "subphrases" else c.table(f"subphrases_{s.get('sourceTable')}")
    predicted = c.table(f"subphrases_{s.get('predictedTable')}")
    error = (absolute_error if s.get("metric", "mse") == "abs" else squared_error)(predicted, observed)
    made = error.select(F.lit(s.get("predictedTable")).alias("prediction"), "identifier", "error")
    name = f"bucket_{s.get('bucket')}"
    return c.with_table(name, c.table(name).unionByName(made) if c.has(name) else made)


def _fixed_of(s: Spec):
    scores = lambda kind: {w.get("string"): w.get("prob", 0.0, float) for e in s.all(kind) for w in e.all("Word")}
    return lambda train, marks, test: fixed(test, scores("EntryNodes"), scores("ForwardTransitionNodes"))


def _of_crf(train: DataFrame, marks: DataFrame, test: DataFrame) -> DataFrame:
    return crf_annotation(test, crf_model(train, marks))


def _of_markov(train: DataFrame, marks: DataFrame, test: DataFrame) -> DataFrame:
    return markov(test, markov_model(marked_words(train, marks)))


#: annotators for cross validation: step -> f(training documents, their annotations, test documents)
TAGGERS = {
    "NLTKSubjectivePhraseBayesianAnnotator": lambda s: lambda train, marks, test: bayesian(test, bayes_table(class_counts(train, marks))),
    "NLTKSubjectivePhraseMarkovAnnotator": lambda s: _of_markov,
    "CRFSubjectiveAnnotator": lambda s: _of_crf,
    "FixedSubjectivePhraseAnnotator": _fixed_of,
    "SubjectiveEvolution": lambda s: lambda train, marks, test: evolved(test, evolve(train, marks, s.get("generations", None, int), seed=s.get("seed", 0, int))),
}


@operator("SubjectiveCrossValidationEnvironment", (), ("folds", "seed", "bucket"))
def _cross(c: Corpus, s: Spec) -> Corpus:
    """Summed squared error of each nested annotator in each fold, into a bucket; they are told apart by name and place."""
    unknown = sorted({child.name for child in s.children} - TAGGERS.keys())
    if unknown:
        raise ValueError(f"no cross validation of {', '.join(unknown)}; there is one of {', '.join(sorted(TAGGERS))}")
    marks = c.dependent("subphrases").select(F.col("document_identifier").alias("identifier"), "annotation")
    out = None
    for k, child in enumerate(s.children):
        made = cross_validate(c.input, marks, TAGGERS[child.name](child), s.get("folds", 10, int), s.get("seed", 0, int))
        made = made.withColumns({"prediction": F.lit(child.name), "place": F.lit(k)})
        out = made if out is None else out.unionByName(made)
    return c if out is None else c.with_table(f"bucket_{s.get('bucket', 'folds')}", durable(out))
