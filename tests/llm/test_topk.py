"""Exact search against all inner products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import topk
from larkspur.llm.topk import ImpactIndex, scaled, top_k


def brute(ids, rows, q, skip, k=5):
    s = rows @ q
    return [(int(ids[j]), int(s[j])) for j in np.lexsort((ids, -s)) if ids[j] != skip][:k]


def test_index_on_random_integers():
    rng = np.random.default_rng(2)
    for _ in range(120):
        n, d, top = int(rng.integers(1, 80)), int(rng.integers(1, 10)), int(rng.integers(1, 300))
        rows = rng.integers(-top, top + 1, (n, d)) * rng.integers(0, 2, (n, 1))
        ids = rng.permutation(n) * 3
        index = ImpactIndex(ids, rows)
        for i in range(n):
            assert index.search(rows[i], 5, ids[i]) == brute(ids, rows, rows[i], ids[i])
        assert index.search(np.zeros(d, int), 3) == brute(ids, rows, np.zeros(d, int), None, 3)


def test_query_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "ASKED", 7)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 0.2, (150, 16)), np.repeat(rng.normal(0, 0.2, (1, 16)), 30, 0)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.1, None]), (902, [float("nan")] * 16), (903, [float("inf")] * 16), (950, None)]
    vectors = scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = top_k(vectors, vectors.where("vec_id % 10 = 0")).collect()
    whole = np.floor(256 * x.astype(float)).astype(int)
    want = {(i, r + 1, v, s) for i in range(0, 180, 10) for r, (v, s) in enumerate(brute(np.arange(180), whole, whole[i], i))}
    assert {tuple(r) for r in got} == want


def test_sums_beyond_64_bits():
    """Components of up to 2**53: sums of products are whole and exact."""
    rng = np.random.default_rng(8)
    for top in (10**6, 10**8, 10**9, 2**38, 2**53):
        for _ in range(8):
            rows = rng.integers(-top, top + 1, (60, 64))
            ids = rng.permutation(60)
            index = ImpactIndex(ids, rows)
            for i in range(0, 60, 7):
                s = [sum(int(a) * int(b) for a, b in zip(r, rows[i], strict=True)) for r in rows]
                want = sorted(((int(ids[j]), s[j]) for j in range(60) if j != i), key=lambda x: (-x[1], x[0]))[:5]
                assert index.search(rows[i], 5, ids[i]) == want


def test_repeated_null_and_clashing(spark):
    """Repeated rows are rows each, null ids take no part, further columns are ignored."""
    rows = [(0, [1.0, 0.0], 7), (0, [1.0, 0.0], 8), (3, [0.5, 0.5], 7), (3, [0.5, 0.5], 7), (3, [0.5, 0.5], 9), (4, [-1.0, 2.0], 7), (None, [9.0, 9.0], 7), (5, [], 7), (6, None, 7)]
    vectors = scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>, v int").withColumn("rank", F.lit("x")).withColumn("block", F.lit("y")))
    got = sorted(tuple(r) for r in top_k(vectors, vectors.where("vec_id IN (3, 4)")).collect())
    x = {0: (256, 0), 3: (128, 128), 4: (-256, 512), 5: (0, 0)}
    known = [0, 0, 3, 3, 3, 4, 5]
    want = []
    for q, times in ((3, 3), (4, 1)):
        best = sorted(((x[q][0] * x[c][0] + x[q][1] * x[c][1], c) for c in known if c != q for _ in range(times)), key=lambda s: (-s[0], s[1]))[:5]
        want += [(q, r + 1, c, s) for r, (s, c) in enumerate(best)]
    assert got == sorted(want)
    with pytest.raises(Exception, match="beyond 2"):
        scaled(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")).collect()


def test_few_or_no_rows(spark):
    vectors = scaled(spark.createDataFrame([(0, [0.5, 0.25]), (1, [1.0])], "vec_id long, embedding array<double>"))
    assert {tuple(r) for r in top_k(vectors, vectors).collect()} == {(0, 1, 1, 128 * 256), (1, 1, 0, 128 * 256)}
    assert top_k(vectors.limit(0), vectors.limit(0)).count() == 0
