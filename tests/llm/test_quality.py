"""Quality rules against a plain Python version."""

import math
import re
from collections import Counter

import xxhash

from larkspur.llm.quality import PRIOR, ngram_weights, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    "one two three four five six seven eight nine ten eleven twelve",
    "a b c d e f a b c d e f a b c d e",
    None,
    "",
    "  \t\n ",
    "short text",
    "line one is here\nline one is here\n\nline two # * $ % & | < >\nline one is here",
    "ünï cödé wörds äre öf 字 many kinds and so on ok",
    "x " * 3000,
    "good words of a kind " + " ".join(f"w{i}" for i in range(500)),
]


def seed(v):
    return v if v >= 0 else v + 2**64


def bucket(*words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h >> 48


def counts(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def brute(rows, trusted, threshold):
    grams = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        grams[i] = [bucket(x) for x in w] + [bucket(a, b) for a, b in zip(w, w[1:])]
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if i in trusted:
            target.update(g)
    share = sum(target.values()) / sum(raw.values())
    out = {}
    for i, text in rows:
        n, c, s, d, p = counts(text)
        failed = n < 10 or 100 * p > 20 * n
        total = sum(round(1000 * math.log((target[b] + PRIOR) / (raw[b] * share + PRIOR))) for b in grams[i])
        out[i] = (n, c, s, d, p, failed, not failed and total >= threshold * len(grams[i]))
    return out


def test_brute_force(spark):
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(f"v{(i * 7 + k) % 90}" for k in range(12 + i))) for i in range(30)]
    trusted = {0, 7, 9, *range(100, 115)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for threshold in (-100, 0, 50):
        got = quality_rules(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), threshold=threshold).collect()
        want = brute(rows, trusted, threshold)
        assert {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in got} == want


def test_a_filter_on_results_stays_above_them(spark):
    """Else the steps' expressions end up within each other's lambdas."""
    long = " ".join(f"w{i % 700}" for i in range(6000))
    docs = spark.createDataFrame([(i, long) for i in range(3)], "doc_id long, text string")
    assert quality_rules(docs, docs.select("doc_id")).where("NOT kept AND n_words = 6000").select("doc_id").count() == 3


def test_very_long_texts(spark):
    """20,000 words and lines, most of them once and most of them again and again."""
    long = [" ".join(f"w{i}" for i in range(20_000)), "\n".join(f"same line {i % 50}" for i in range(20_000)), "z" * 300_000]
    rows = list(enumerate(long))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules(docs, docs.select("doc_id")).collect()}
    assert got == {i: counts(t) for i, t in rows}


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, kept string")
    assert quality_rules(none, none.select("doc_id")).count() == 0
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, None, None, None)], "doc_id long, text string, n_words int, id string")
    got = quality_rules(docs, docs.select("doc_id")).collect()
    assert [r["n_words"] for r in sorted(got, key=lambda r: r["n_words"])] == [0, 2, 2]
    assert not any(r["kept"] for r in got)


def test_all_trusted_documents_count(spark):
    rows = [(i, f"w{i % 97} v{i % 1009} end") for i in range(24_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    raw, target = Counter(), Counter()
    for i, text in rows:
        w = text.split()
        grams = [bucket(x) for x in w] + [bucket(a, b) for a, b in zip(w, w[1:])]
        raw.update(grams)
        if i % 5:
            target.update(grams)
    share = sum(target.values()) / sum(raw.values())
    got = ngram_weights(docs, docs.where("doc_id % 5 > 0").select("doc_id"))
    assert all(got[b] == round(1000 * math.log((target[b] + PRIOR) / (n * share + PRIOR))) for b, n in raw.items())
