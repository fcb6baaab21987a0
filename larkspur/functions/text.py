"""Column helpers for short texts; all of them run inside Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Space-split words, empty ones included, so positions match annotation strings."""
    return F.split(text, " ")


def like_ascii(text: Column, pattern: str) -> Column:
    """LIKE that ignores the case of ASCII letters only and has no escape character."""
    fold = pattern.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\")
    return F.translate(text, _UPPER, _LOWER).like(fold)


def letters_only(text: Column) -> Column:
    """ASCII letters and spaces; other characters go."""
    return F.regexp_replace(text, "[^a-zA-Z ]", "")


def tweet_token(word: Column) -> Column:
    """Lower case, cut at the first character outside [a-z#@]; whole if that is the first, as in an emoticon."""
    low = F.lower(word)
    return F.when(low.rlike("^[a-z#@]"), F.regexp_extract(low, "^[a-z#@]+", 0)).otherwise(low)


def tweet_tokens(text: Column) -> Column:
    return F.filter(F.transform(words(text), tweet_token), lambda t: t != "")


def letter_runs(text: Column) -> Column:
    """Maximal runs of [A-Za-z@#]."""
    return F.regexp_extract_all(text, F.lit("([A-Za-z@#]+)"), 1)


def once(value: Column, f) -> Column:
    """f(value), where value is evaluated once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def pairs(tokens: Column, start: int = 0, joiner: str = " ") -> Column:
    """Adjacent tokens joined, from position start on."""
    n = lambda t: F.greatest(F.size(t) - 1 - start, F.lit(0))
    return once(tokens, lambda t: F.zip_with(F.slice(t, start + 1, n(t)), F.slice(t, start + 2, n(t)), lambda a, b: F.concat_ws(joiner, a, b)))


def triples(tokens: Column, joiner: str = " ") -> Column:
    """Three neighbouring tokens joined."""
    n = lambda t: F.greatest(F.size(t) - 2, F.lit(0))
    both = lambda t: F.zip_with(F.slice(t, 1, n(t)), F.slice(t, 2, n(t)), lambda a, b: F.concat_ws(joiner, a, b))
    return once(tokens, lambda t: F.zip_with(both(t), F.slice(t, 3, n(t)), lambda ab, c: F.concat_ws(joiner, ab, c)))


def without_urls(text: Column) -> Column:
    """Tokens that contain http go; the rest is joined again."""
    return F.array_join(F.filter(words(text), lambda w: ~w.contains("http")), " ")


def phrase_runs(annotation: Column, mark: str) -> Column:
    """How many runs of at least two of a mark an annotation string holds."""
    return F.size(F.regexp_extract_all(annotation, F.lit(f"({mark}{mark}+)"), 1))


def mark_count(annotation: Column, mark: str) -> Column:
    """Characters of an annotation that are mark."""
    return F.length(annotation) - F.length(F.replace(annotation, F.lit(mark), F.lit("")))


def mark_share(annotation: Column, text: Column, mark: str) -> Column:
    """Characters of an annotation that are mark, per space-split word."""
    return mark_count(annotation, mark).cast("double") / F.size(words(text))


def decile(p: Column) -> Column:
    """Class of a share: floor((p - 0.001) * 10), zero at least."""
    return F.greatest(F.floor((p - F.lit(0.001)) * 10), F.lit(0)).cast("int")


def regexp_stem(word: Column) -> Column:
    """Words of four letters or more lose a final ing, s or e."""
    return F.when(F.length(word) >= 4, F.regexp_replace(word, "(ing|s|e)$", "")).otherwise(word)
