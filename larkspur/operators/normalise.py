"""Word normalisation: stop words, stemming, lemmas, folding to ASCII.

Folding and Porter's stemmer have no equal among Spark's functions; both run on
Arrow batches over distinct words only.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..corpus import Corpus
from ..functions.text import regexp_stem, words
from ..registry import Spec, operator
from .features import STOP_WORDS


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _measure(w: str) -> int:
    """How often a vowel is followed by a consonant."""
    kinds = [_vowel(w, i) for i in range(len(w))]
    return sum(a and not b for a, b in zip(kinds, kinds[1:]))


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and not _vowel(w, n - 3) and _vowel(w, n - 2) and not _vowel(w, n - 1) and w[-1] not in "wxy"


#: fixed values: suffix pairs of Porter's steps 2 and 3, and suffixes of step 4, in the published order
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _swap(w: str, pairs: str) -> str:
    table = dict(p.split(":") for p in pairs.split(" "))
    for end in sorted(table, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem + table[end] if _measure(stem) > 0 else w
    return w


@lru_cache(1 << 18)
def porter(word: str) -> str:
    """Porter's stemmer as published in 1980; words of at most two letters stay."""
    w = word.lower()
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2), _STEP3)
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def ascii_fold(text: str) -> str:
    """Compatibility decomposition, then ASCII characters only."""
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


def _batched(f):
    def run(s):
        return s.map(lambda x: None if x is None else f(x))

    run.__annotations__ = {}
    from pyspark.sql.pandas.functions import PandasUDFType

    return F.pandas_udf(run, "string", PandasUDFType.SCALAR)


def folded(text: Column) -> Column:
    return _batched(ascii_fold)(text)


@dataclass(frozen=True)
class Normaliser:
    """stemmer: none, regexp or porter; lemmas: (word, lemma) table applied after it."""

    stop_words: bool = True
    stemmer: str = "none"
    lower: bool = True
    strip: str | None = None

    def word(self, w: Column) -> Column:
        out = F.lower(w) if self.lower else w
        if self.stemmer == "regexp":
            out = regexp_stem(out)
        if self.strip:
            out = F.regexp_replace(out, self.strip, "")
        if self.stop_words:
            out = F.when(F.lower(w).isin(list(STOP_WORDS)), "STOPPED").otherwise(out)
        return F.when(out == "", "FILTERED").otherwise(out)


def normalised_words(df: DataFrame, options: Normaliser = Normaliser(), lemmas: DataFrame | None = None) -> DataFrame:
    """identifier, at, word of each space-split word; stop words are STOPPED, words stripped bare FILTERED.

    Porter's stemmer and lemmas are looked up by distinct word.
    """
    rows = df.select("identifier", F.posexplode(words(F.col("document"))).alias("at", "raw"))
    distinct = rows.select("raw").distinct().withColumn("word", options.word(F.col("raw")))
    marked = F.col("word").isin("STOPPED", "FILTERED")
    if options.stemmer == "porter":
        distinct = distinct.withColumn("word", F.when(marked, F.col("word")).otherwise(_batched(porter)(F.col("word"))))
    elif options.stemmer not in ("none", "regexp"):
        raise ValueError(f"no stemmer {options.stemmer}")
    if lemmas is not None:
        table = lemmas.select(F.col("word").alias("_from"), F.col("lemma").alias("_to")).dropDuplicates(["_from"])
        distinct = distinct.join(table, F.col("word") == F.col("_from"), "left").select("raw", F.coalesce("_to", "word").alias("word"))
    return rows.join(distinct, "raw").select("identifier", "at", "word")


def evolution_words(text: Column) -> Column:
    """Space-split words: stop words, mentions and words stripped bare are one word each; others are stemmed unless they
    hold #, and keep [a-z0-9#]."""
    plain = F.transform(words(text), lambda w: F.when(F.lower(w).isin(list(STOP_WORDS)), "STOPPED_WORD").when(w.contains("@"), "AT").otherwise(F.lower(w)))
    stems = _arrays(lambda w: w if "#" in w or w in ("STOPPED_WORD", "AT") else porter(w))(plain)
    kept = F.transform(stems, lambda w: F.when(w.isin("STOPPED_WORD", "AT"), w).otherwise(F.regexp_replace(F.lower(w), "[^a-z0-9#]", "")))
    return F.transform(kept, lambda w: F.when(w == "", "FILTERED_WORD").otherwise(w))


_OTHER = re.compile("[^a-z0-9#]")


@lru_cache(1 << 18)
def evolution_word(w: str) -> str:
    """What ``evolution_words`` makes of a word."""
    low = w.lower()
    if low in STOP_WORDS:
        return "STOPPED_WORD"
    if "@" in w:
        return "AT"
    return _OTHER.sub("", low if "#" in low else porter(low)) or "FILTERED_WORD"


def _arrays(f):
    from pyspark.sql.pandas.functions import PandasUDFType

    return F.pandas_udf(lambda s: s.map(lambda ws: None if ws is None else [f(w) for w in ws]), "array<string>", PandasUDFType.SCALAR)


@operator("SubjectiveWordNormaliser", ("table",), ("stopWords", "stemmer", "lower", "strip"))
def _normalise(c: Corpus, s: Spec) -> Corpus:
    options = Normaliser(s.get("stopWords", True, bool), s.get("stemmer", "none"), s.get("lower", True, bool), s.get("strip"))
    made = normalised_words(c.input, options, c.table("lemmas") if c.has("lemmas") else None)
    again = made.groupBy("identifier").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("s"))
    return c.with_table(f"pos_norm_{s.get('table')}", again.select(F.col("identifier").alias("document_identifier"), F.array_join("s.word", " ").alias("document")))
