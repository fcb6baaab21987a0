"""Near copies against all pairs."""

import numpy as np
import pytest

from larkspur.llm import vector_dedup
from larkspur.llm.vector_dedup import Blocks, near_copies, rotate, units


def brute(rows, threshold):
    """rows: (id, vector or None, label).  Links and least reachable id of each row."""
    width = max([len(v) for _, v, _ in rows if v is not None] or [1])
    fine = [v is not None and la is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, la in rows]
    m = np.zeros((len(rows), width))
    for i, (_, v, _) in enumerate(rows):
        if fine[i]:
            m[i, : len(v)] = v
    m /= np.where(np.linalg.norm(m, axis=1) > 0, np.linalg.norm(m, axis=1), 1)[:, None]
    label = [r[2] for r in rows]
    link = np.array([[fine[i] and fine[j] and i != j and label[i] == label[j] for j in range(len(rows))] for i in range(len(rows))]) & (m @ m.T >= threshold)
    ids, least = [r[0] for r in rows], np.array([r[0] for r in rows])
    while True:
        new = np.array([min([least[i], *least[link[i]]]) for i in range(len(rows))])
        if (new == least).all():
            break
        least = new
    return sorted((ids[i], int(link[i].sum()), int(least[i]), ids[i] == int(least[i])) for i in range(len(rows)))


def data(n, d, groups, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    rows = [(10 * i, v.tolist(), int(rng.integers(3))) for i, v in enumerate(base)]
    for g in range(groups):
        for k in range(int(rng.integers(1, 30))):
            v = base[g] / np.linalg.norm(base[g]) + rng.normal(size=d) * rng.choice([0, 0.01, 0.02, 0.03]) * np.sqrt(64 / d)
            rows.append((100_000 + 100 * g + k, (v * rng.choice([0.5, 1, 40])).tolist(), int(rng.choice([rows[g][2], rows[g][2], 0]))))
    return rows


def test_rotation_keeps_distances_and_bits():
    x = np.random.default_rng(0).normal(size=(50, 48))
    u = units(x)
    r = rotate(u)
    assert np.allclose(r @ r.T, u @ u.T)
    assert (rotate(units(x[7:8])) == r[7:8]).all()  # whatever stands beside a row


def test_a_linked_pair_is_within_a_block_s_range_and_meets_in_a_cell():
    rng = np.random.default_rng(1)
    for d in (2, 3, 17, 64):
        x = units(rng.normal(size=(400, d)))
        y = units(x + rng.normal(size=(400, d)) * rng.choice([0.001, 0.01, 0.03], (400, 1)) * 8 / np.sqrt(d))
        rows = np.concatenate([rotate(x), rotate(y)])
        linked = np.flatnonzero((x * y).sum(1) >= 0.98)
        blocks = Blocks(rows.shape[1], 0.98)
        assert abs(blocks.budget.sum() - 0.04) < 1e-6
        found = np.zeros(400, bool)
        for b in range(len(blocks)):
            near = blocks.within(rows, np.arange(400), np.arange(400, 800), b)
            found |= near
            at, low = blocks.cells(rows, b, np.full(800, 10**9))
            lower = np.minimum(at[:400], at[400:])
            for side, flags in ((at[:400], low[:400]), (at[400:], low[400:])):
                gets_there = ((side == lower) | ((side == lower + 1) & flags)).all(axis=1)
                assert gets_there[near].all()
        assert len(linked) > 50 and found[linked].all()


@pytest.mark.parametrize("chunk, full", [(4096, 2048), (16, 20)])
def test_equal_to_all_pairs(spark, monkeypatch, chunk, full):
    """With small cells and chunks too."""
    monkeypatch.setattr(vector_dedup, "CHUNK", chunk)
    for d, seed in ((64, 2), (5, 3)):
        rows = data(150, d, 9, seed)
        rows += [(5, None, 1), (6, [0.0] * d, 1), (7, [1.0] * (d - 1) + [float("nan")], 1), (8, [1.0] * (d - 1) + [None], 1), (9, [], 1), (11, [1.0], 1), (12, [2.0, 0.0], 1), (13, [3.0], None)]
        rows += [(i, rows[0][1], rows[0][2]) for i in range(200_000, 200_060)]
        df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, label int, node long, links string")
        got = sorted(tuple(r) for r in near_copies(df, full=full).collect())
        assert got == brute(rows, 0.98)


def test_empty_repeated_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert near_copies(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (None, [2.0, 0.0], "a"), (None, None, "a")]
    got = sorted((tuple(r) for r in near_copies(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (1, 0, 1, True), (None, 2, 1, False), (None, 0, None, True)], key=str)
    with pytest.raises(ValueError):
        near_copies(spark.createDataFrame(rows, schema), 0)
