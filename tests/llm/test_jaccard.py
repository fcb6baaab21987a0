"""Near-duplicate classes against all pairs compared one by one."""

import random
import re

from pyspark.sql import functions as F

from larkspur.llm import common, jaccard_join
from larkspur.llm.jaccard_join import jaccard_classes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    links = dict.fromkeys(parent, 0)
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                links[i] += 1
                links[j] += 1
    return {i: (len(s), find(i), links[i]) for i, s in sets}


def near_copies(rng, n, size, change):
    base = [f"w{rng.randrange(400)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(change):
            w[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_classes(docs).collect()}
    assert got == brute(rows)


def test_random_groups(spark):
    rng = random.Random(5)
    texts = []
    for size, change in ((8, 1), (40, 1), (60, 2), (150, 3), (200, 6)):
        texts += near_copies(rng, 14, size, change)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    texts += ["", " \n", None, "one", "ONE", "one two three", "a b c d e", "a b c d e", "A B C D E"]
    rng.shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_hot_columns_and_several_blocks(spark, monkeypatch):
    """More copies than a column pairs, and clusters of more rows than a block."""
    rng = random.Random(7)
    texts = near_copies(rng, 130, 60, 2) + near_copies(rng, 90, 30, 1) + ["same text for all of these rows here"] * 100
    monkeypatch.setattr(jaccard_join, "ROWS", 50)
    check(spark, list(enumerate(texts)))


def test_wide_columns_and_large_tables(spark, monkeypatch):
    """Few rows make a column frequent, hot or wide, few columns are known, and no table is small."""
    rng = random.Random(11)
    texts = near_copies(rng, 40, 60, 2) + near_copies(rng, 30, 9, 1) + near_copies(rng, 30, 45, 1) + ["same text for all of these rows here"] * 50
    texts += [t + " and some more words at the end" for t in texts[:60]]
    monkeypatch.setattr(jaccard_join, "FREQUENT", 3)
    monkeypatch.setattr(jaccard_join, "WIDE", 8)
    monkeypatch.setattr(jaccard_join, "HOT", 5)
    monkeypatch.setattr(jaccard_join, "CELLS", 600)
    monkeypatch.setattr(common, "SMALL", 0)
    monkeypatch.setattr(common, "HEAVY", 10)
    check(spark, list(enumerate(texts)))
    monkeypatch.setattr(jaccard_join, "COLUMNS", 40)
    monkeypatch.setattr(jaccard_join, "SLICE", 500)
    monkeypatch.setattr(jaccard_join, "HELD", 900)
    check(spark, list(enumerate(texts)))


def test_repeated_ids(spark):
    """Rows of one id are rows each; copies of a text link whatever their ids are."""
    a, b = "a b c d e f g h", "q r s t u v w x"
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (5, b), (7, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard_classes(docs).collect())
    assert got == [(3, 3, 1), (5, 3, 1), (5, 5, 1), (5, 5, 1), (7, 7, 0)]


def test_components(spark, monkeypatch):
    """Paths, hubs and cycles, whole and cut into chunks of few edges."""
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(80)] + [(300 + i, 300 + (i + 1) % 9) for i in range(9)]
    edges += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        parent[find(x)] = find(y)
    alone = {x for x in parent if all(a == b for a, b in edges if x in (a, b))}
    for chunk, small in ((1_000_000, 1000), (5, 0)):
        monkeypatch.setattr(common, "CHUNK", chunk)
        monkeypatch.setattr(common, "SMALL", small)
        got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
        assert set(got) == set(parent) - alone
        assert len({(find(x), got[x]) for x in got}) == len({find(x) for x in got}) == len(set(got.values()))


def test_threshold_is_met_exactly(spark):
    # 6 of 8 shingles in common is 0.75; 5 of 7 is less
    a = [f"w{i}" for i in range(11)]
    check(spark, [(3, " ".join(a)), (5, " ".join(a[:10] + ["z"])), (9, " ".join(["q", *a[:9]]))])


def test_empty_null_and_clashing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_classes(none).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f", 3), (None, "a b c d e f", 4), (2, None, 5)], "doc_id long, text string, v int").withColumn("id", F.lit("x"))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_classes(rows).collect()}
    assert got == {1: 1, 2: 2}
    wordless = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert {r["n_shingles"] for r in jaccard_classes(wordless).collect()} == {0}


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    check(spark, [(1, long), (2, long + " tail"), (3, "short")])
