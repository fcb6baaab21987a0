"""Tokenisers, token dictionaries and filters on token sequences.

A tokenised corpus is two tables: ``pos_tokens_<x>`` (identifier, token) and ``pos_<x>``
(identifier, document_identifier, tokens: array of token ids).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from ..checkpoint import durable, scratch
from ..corpus import Corpus
from ..functions.text import like_ascii, tweet_tokens
from ..registry import Spec, operator
from .labels import number

#: Taggers that need a model of their own: name -> f(column of text) -> column array<string> of word/TAG.
TAGGERS: dict[str, Callable[[Column], Column]] = {}


FEW = 10_000  # ids that a plan may hold
COMMON = 500_000  # values that are sent to the tasks; others are joined


def replaced(df: DataFrame, key: str, lists: str, table: DataFrame, most: int = COMMON) -> DataFrame:
    """df with each value of the array column lists replaced by what table (two columns, each value once) has for it, else null.

    Up to ``most`` values, the most frequent where there are more, go to every task, which looks up a row's values in place.  Only
    other values are rows that are shuffled: each once for a row of df, which key tells from others.
    """
    a, b = "_a", "_b"  # the table's names may be those of df
    table = table.toDF(a, b)
    kind = table.schema[b].dataType
    few = table.limit(most + 1).toArrow().combine_chunks()
    whole = few.num_rows <= most
    if not whole:
        counts = df.select(F.explode(lists).alias(a)).groupBy(a).agg(F.count("*").alias("_n"))
        step, every, least = F.floor(F.log2("_n") * 8), 0, float("inf")
        counts = durable(counts)
        for r in counts.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():  # a few hundred steps
            every += r["count"]
            least = r["s"] if every <= most else least
        few = table.join(counts.where(step >= least).select(a), a, "left_semi").select(a, b).toArrow().combine_chunks()
    flat = lambda name: few.column(name).combine_chunks() if few.num_rows else pa.array([], few.schema.field(name).type)
    sent = df.sparkSession.sparkContext.broadcast((flat(a), flat(b)))

    def run(x):
        keys, values = sent.value
        n = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(x).dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=keys.cast(coded.dictionary.type))
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, values.take(found.take(coded.indices)))

    look = F.arrow_udf(run, f"array<{kind.simpleString()}>", ArrowUDFType.SCALAR)
    full = F.coalesce(F.col(lists), F.array().cast(df.schema[lists].dataType))
    if whole:
        return df.withColumn(lists, look(full))
    made = df.withColumns({"_old": full, lists: look(full)})
    rest = made.select(key, F.explode(F.array_distinct(F.filter(F.zip_with("_old", lists, lambda x, y: F.when(y.isNull(), x)), lambda x: x.isNotNull()))).alias(a))
    rest = rest.join(table, a).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(a, b))).alias("_rare"))
    filled = F.zip_with("_old", lists, lambda x, y: F.coalesce(y, F.try_element_at("_rare", x)))
    return made.join(rest, key, "left").withColumn(lists, F.when(F.col("_rare").isNull(), F.col(lists)).otherwise(filled)).select(*df.columns)


def tokenised(df: DataFrame, tokens: Column) -> tuple[DataFrame, DataFrame]:
    """(dictionary, sequences) of the tokens of df's documents, in order; null tokens are left out."""
    rows = df.select("identifier", F.array_compact(tokens).alias("tokens"))
    names = durable(number(rows.select(F.explode("tokens").alias("token")).distinct(), "token", 1, "identifier").select("identifier", "token"))
    ids = replaced(rows, "identifier", "tokens", names.select("token", "identifier"))
    return names, ids.select("identifier", F.col("identifier").alias("document_identifier"), "tokens")


def spelled(sequences: DataFrame, names: DataFrame) -> DataFrame:
    """The sequences with tokens in place of ids."""
    return replaced(sequences, "document_identifier", "tokens", names.select("identifier", "token"))


def token_rows(sequences: DataFrame) -> DataFrame:
    return sequences.select("document_identifier", F.posexplode("tokens").alias("at", "identifier"))


def token_counts(sequences: DataFrame) -> DataFrame:
    return token_rows(sequences).groupBy("identifier").agg(F.count("*").alias("n"))


def matching(names: DataFrame, part: str, before: bool = True, after: bool = True) -> DataFrame:
    """Ids of tokens LIKE %part%; before and after: whether any text may stand there."""
    return names.where(like_ascii(F.col("token"), ("%" if before else "") + part + ("%" if after else ""))).select("identifier")


def between(counts: DataFrame, least: int, most: int) -> DataFrame:
    """Rows with least < n <= most."""
    return counts.where((F.col("n") > least) & (F.col("n") <= most))


def unpopular(sequences: DataFrame, least: int, most: int) -> DataFrame:
    """Ids of tokens with least < frequency <= most."""
    return between(token_counts(sequences), least, most).select("identifier")


def without_tokens(sequences: DataFrame, ids: DataFrame) -> DataFrame:
    """The sequences without the given ids; repeats of other tokens and empty sequences stay.

    Up to ``FEW`` ids are looked up in a set that the plan holds; more are looked up as ``replaced`` does.
    """
    few = [r[0] for r in ids.limit(FEW + 1).collect()]
    if len(few) <= FEW:
        return sequences.withColumn("tokens", F.filter("tokens", lambda t: ~t.isin(few)) if few else F.col("tokens"))
    gone = replaced(sequences.withColumn("_gone", F.col("tokens")), "document_identifier", "_gone", ids.select("identifier", F.lit(True).alias("gone")).distinct())
    kept = F.filter(F.arrays_zip("tokens", "_gone"), lambda x: x["_gone"].isNull())
    return gone.withColumn("tokens", F.transform(kept, lambda x: x["tokens"])).select(*sequences.columns)


def rewritten(df: DataFrame, tokens: Column, part: str) -> DataFrame:
    """identifier, document_identifier, tokens: those of each document that aren't LIKE %part%, spelled.

    What ``tokenised``, ``without_tokens`` of ``matching`` and ``spelled`` give one after the other; as a token's spelling says whether
    it goes, none has to be numbered, looked up or shuffled.
    """
    kept = F.filter(F.array_compact(tokens), lambda t: ~like_ascii(t, f"%{part}%"))
    return df.select("identifier", F.col("identifier").alias("document_identifier"), kept.alias("tokens"))


def greedy_phrases(text: Column, phrases: list[str]) -> Column:
    """Words with the known multi-word phrases joined by _, longer phrases first.

    Every word stands between two spaces of its own, so neighbouring phrases don't share one.
    """
    known = sorted({tuple(p.replace("_", " ").split(" ")) for p in phrases if " " in p or "_" in p}, key=lambda p: (-len(p), p))
    out = F.concat(F.lit(" "), F.array_join(F.split(F.lower(text), " "), "  "), F.lit(" "))
    for p in known:
        out = F.replace(out, F.lit(" " + "  ".join(p) + " "), F.lit(" " + "_".join(p) + " "))
    return F.filter(F.split(out, " "), lambda w: w != "")


PHRASES = 500_000  # phrases of a trie that is sent to tasks; of more, their places are found by a join


def phrase_trie(phrases: list[str]) -> tuple[dict[tuple[int, str], int], set[int]]:
    """(steps, ends): from a node and a word to the next node, and the nodes where a phrase ends; the root is 0."""
    steps: dict[tuple[int, str], int] = {}
    ends: set[int] = set()
    for p in phrases:
        at = 0
        for w in p.split("_"):
            at = steps.setdefault((at, w), len(steps) + 1)
        ends.add(at)
    return steps, ends


def longest_phrases(words_: list[str], trie: tuple[dict[tuple[int, str], int], set[int]]) -> list[str]:
    """The words, with the longest phrase that begins at each, from the left, joined by _."""
    steps, ends = trie
    out, k = [], 0
    while k < len(words_):
        at, size, j = 0, 1, k
        while j < len(words_) and (at := steps.get((at, words_[j]), 0)):
            j += 1
            if at in ends:
                size = j - k
        out.append("_".join(words_[k : k + size]))
        k += size
    return out


def phrase_tokens(df: DataFrame, phrases: DataFrame, most: int = PHRASES) -> DataFrame:
    """identifier, tokens: the words of each text in lower case, with known phrases of several words joined by _.

    phrases: (phrase), its words apart by blanks or _, of any case; those of one word say nothing.  At each word the longest phrase
    that begins there is taken, and the search goes on after it.  Up to ``most`` phrases are a trie in every
    task; of more, runs of words are joined with them, and a text is put together from the longest at each place.
    A null text has no tokens.
    """
    low = F.filter(F.split(F.lower(F.coalesce("document", F.lit(""))), r"\s+"), lambda w: w != "")
    clean = F.array_join(F.filter(F.split(F.lower(F.regexp_replace("phrase", "_", " ")), r"\s+"), lambda w: w != ""), "_")
    known = phrases.select(clean.alias("phrase")).where(F.col("phrase").contains("_")).distinct()
    rows = df.select("identifier", low.alias("w"))
    few = known.limit(most + 1).collect()
    if len(few) <= most:
        sent = df.sparkSession.sparkContext.broadcast(phrase_trie(sorted(r[0] for r in few)))

        def run(it):
            for batch in it:
                found = [longest_phrases(w, sent.value) for w in batch.column("w").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("identifier"), pa.array(found, pa.list_(pa.string()))], names=["identifier", "tokens"])

        return rows.mapInArrow(run, f"identifier {df.schema['identifier'].dataType.simpleString()}, tokens array<string>")
    sizes = [r[0] for r in known.select(F.size(F.split("phrase", "_"))).distinct().collect()]  # lengths of phrases
    grams = lambda n: F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice("w", i + 1, n), "_").alias("phrase")))
    runs = F.flatten(F.array(*(F.when(F.size("w") >= n, grams(n)).otherwise(F.array().cast("array<struct<at:int,n:int,phrase:string>>")) for n in sorted(sizes))))
    hits = rows.select("identifier", F.inline(runs)).join(known, "phrase").groupBy("identifier", "at").agg(F.max("n").alias("n"))
    places = hits.groupBy("identifier").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("at"))
    # each word is taken with the place where the text goes on
    step = lambda acc, i: F.when(i < acc["next"], acc).otherwise(F.struct(F.array_append(acc["out"], F.array_join(F.slice("w", i + 1, _size(i)), "_")).alias("out"), (i + _size(i)).alias("next")))
    _size = lambda i: F.coalesce(F.try_element_at("at", i), F.lit(1))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("next"))
    every = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1)).otherwise(F.array().cast("array<int>"))
    return rows.join(places, "identifier", "left").select("identifier", F.aggregate(every, start, step)["out"].alias("tokens"))


def without_marks(tokens: Column) -> Column:
    """Tokens that start with # or @ become empty."""
    return F.transform(tokens, lambda t: F.when(t.startswith("#") | t.startswith("@"), "").otherwise(t))


def tokens_of(c: Corpus, name: str) -> DataFrame:
    """(document_identifier, at, token) of a tokenised table, narrowed to the input."""
    return token_rows(c.dependent(f"pos_{name}")).join(c.table(f"pos_tokens_{name}"), "identifier").select("document_identifier", "at", "token")


def _tagger(name: str, tokens: Callable[[Column], Column]):
    @operator(name, ("dest",), ("verbose",))
    def run(c: Corpus, s: Spec) -> Corpus:
        names, sequences = tokenised(c.input, tokens(F.col("document")))
        return c.with_table(f"pos_tokens_{s.get('dest')}", names).with_table(f"pos_{s.get('dest')}", sequences)

    return run


def _tag_words(items: Column, word: str = "w") -> Column:
    return F.transform(items, lambda x: F.coalesce(x[word], F.lit("")))


def shapes(words_: Column) -> Column:
    """Attributes of words for tagging: the words around, and a word's beginnings, endings and shape."""
    from .crf import text_features

    def more(w: Column) -> Column:
        shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(w, "[A-Z]+", "X"), "[a-z]+", "x"), "[0-9]+", "0")
        ends = [F.concat(F.lit(f"end{k}="), F.lower(F.right(w, F.lit(k)))) for k in (1, 2, 3)]
        return F.array(*ends, F.concat(F.lit("begin="), F.lower(F.left(w, F.lit(2)))), F.concat(F.lit("shape="), shape))

    return F.zip_with(text_features(words_), F.transform(words_, more), lambda a, b: F.concat(a, b))


def train_tagger(sequences: DataFrame, iterations: int = 25):
    """A part-of-speech model of tagged sequences (items: array of structs w, pos), as ``corpora.sequences`` reads them."""
    from . import crf

    rows = sequences.select(F.monotonically_increasing_id().alias("identifier"), shapes(_tag_words(F.col("items"))).alias("features"), F.transform("items", lambda x: x["pos"]).alias("y"))
    with scratch() as keep:
        return crf.train(keep(durable(rows)), iterations=iterations)


def tagged(df: DataFrame, model) -> DataFrame:
    """identifier, tokens: TAG/word of each space-split word of the texts; empty words are left out."""
    from . import crf

    split = F.filter(F.split(F.coalesce("document", F.lit("")), " "), lambda w: w != "")
    rows = df.select("identifier", split.alias("w"))
    found = crf.tag(rows.select("identifier", shapes(F.col("w")).alias("features")), model)
    return rows.join(found, "identifier").select("identifier", F.zip_with("y", "w", lambda t, w: F.concat(t, F.lit("/"), w)).alias("tokens"))


def load_tagger(spark, path: str, *names: str) -> None:
    """Let the named taggers (NLTKPOSTagger, ...) tag by the model that ``crf.save_model`` has kept at path."""
    from pyspark.sql.functions import pandas_udf

    from . import crf

    model = crf.load_model(spark, path)
    width, sent = len(model.columns), spark.sparkContext.broadcast(model)

    def run(s: pd.Series) -> pd.Series:
        import pyarrow as pa

        known = sent.value
        features = pa.array([[a.tolist() for a in x] for x in s], pa.list_(pa.list_(pa.int32())))
        out = []
        for _, _, chains, _ in crf._chains(pa.RecordBatch.from_arrays([features], names=["x"]), known):
            best = chains.best()
            out += [[known.classes[c] for c in best[a : a + n]] for a, n in zip(chains.begin, chains.sizes, strict=True)]
        return pd.Series(out)

    of = pandas_udf(run, "array<string>")

    def tokens(text: Column) -> Column:
        split = F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != "")
        hashed = F.transform(shapes(split), lambda f: F.transform(f, lambda a: F.pmod(F.xxhash64(a), F.lit(width)).cast("int")))
        return F.zip_with(of(hashed), split, lambda t, w: F.concat(t, F.lit("/"), w))

    for name in names:
        TAGGERS[name] = tokens


def _plugged(name: str):
    def tokens(text: Column) -> Column:
        if name not in TAGGERS:
            raise ValueError(f"{name} needs a model: load one by load_tagger, or put a function into TAGGERS")
        return TAGGERS[name](text)

    return tokens


_tagger("WhiteSpacePOSTagger", tweet_tokens)
for _name in ("NLTKPOSTagger", "StanfordTagger", "GimpelPOSTagger"):
    _tagger(_name, _plugged(_name))


def _aligned(text: str, tagged: list[str]) -> list[tuple[int, int, str, str]] | None:
    """(place of the word, place of the token, tag, token) of the tokens (TAG/word) that make up each word; None if a word has none."""
    parts = [t.partition("/") for t in tagged]
    out, at = [], 0
    for k, word in enumerate(w for w in text.split(" ") if w.strip()):
        while at < len(parts) and parts[at][2] not in word:
            at += 1
        if at == len(parts):
            return None
        held = ""
        while at < len(parts) and held + parts[at][2] in word:
            held += parts[at][2]
            out.append((k, at, parts[at][0], parts[at][2]))
            at += 1
    return out


def match_tags(df: DataFrame, text: str = "document", tagged: str = "tokens") -> DataFrame:
    """(identifier, at, token_at, tag, token): the tagger's tokens of each space-split word of a text.

    A tagger may cut a word into several tokens; the tokens of a word are those, in order, that put together
    stand in it.  Documents where a word has no token are left out.
    """
    import pyarrow as pa

    def run(it):
        for batch in it:
            rows = [(i, *r) for i, t, ws in zip(*(c.to_pylist() for c in batch.columns), strict=True) if t is not None and ws is not None for r in _aligned(t, ws) or ()]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["identifier", "at", "token_at", "tag", "token"])

    rows = df.select(F.col("identifier").cast("long").alias("identifier"), F.col(text).cast("string"), F.col(tagged).cast("array<string>"))
    return rows.mapInArrow(run, "identifier long, at int, token_at int, tag string, token string")


_MATCH = ("matchBefore", "matchAfter")


def _tables(s: Spec) -> tuple[str, str]:
    return f"pos_{s.get('src')}", f"pos_tokens_{s.get('src')}"


def _matched(c: Corpus, s: Spec) -> DataFrame:
    return matching(c.table(_tables(s)[1]), s.get("tag"), s.get("matchBefore", True, bool), s.get("matchAfter", True, bool))


@operator("RewritePOSFilter", ("src", "tag"), _MATCH)
def _rewrite(c: Corpus, s: Spec) -> Corpus:
    pos, _ = _tables(s)
    return c.with_table(pos, without_tokens(c.table(pos), _matched(c, s)))


@operator("POSWhiteListFilter", ("src", "dest", "tag"), _MATCH)
def _white_list(c: Corpus, s: Spec) -> Corpus:
    return c.with_table(f"pos_list_{s.get('dest')}", _matched(c, s).withColumnRenamed("identifier", "pos_identifier"))


@operator("POSRewriteFromWhiteList", ("src", "ref"))
def _rewrite_listed(c: Corpus, s: Spec) -> Corpus:
    pos, _ = _tables(s)
    return c.with_table(pos, without_tokens(c.table(pos), c.table(f"pos_list_{s.get('ref')}").select(F.col("pos_identifier").alias("identifier"))))


@operator("POSWhiteListUnpopularTags", ("src", "dest", "maxPopularity"), ("minPopularity",))
def _unpopular(c: Corpus, s: Spec) -> Corpus:
    pos, _ = _tables(s)
    ids = unpopular(c.dependent(pos), s.get("minPopularity", 0, int), s.get("maxPopularity", kind=int))
    return c.with_table(f"pos_list_{s.get('dest')}", ids.withColumnRenamed("identifier", "pos_identifier"))
