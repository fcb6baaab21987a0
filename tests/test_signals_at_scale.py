"""A block of signals is searched by products of single precision; what it finds is what all correlations give."""

import random

import numpy as np
import pyarrow as pa
import pytest

from larkspur.operators import evolve


@pytest.mark.parametrize("seed", range(6))
def test_best_of_a_block_equals_all_correlations(seed):
    rng = random.Random(seed)

    def signal():
        kind = rng.randrange(6)
        n = rng.randrange(12)
        if kind == 0:
            return [0.3] * n
        return [rng.choice([0.0, 0.1, -0.3, 0.7, 1e-9]) for _ in range(n)] if kind < 3 else [rng.uniform(-1, 1) for _ in range(n)]

    known = [(i, signal()) for i in range(80)]
    known += [(200 + i, [2 * x for x in s]) for i, s in known[:40]]
    rng.shuffle(known)
    asked = [(1000 + i, signal()) for i in range(40)] + [(2000 + i, s) for i, s in known[:20]]
    kind = pa.list_(pa.float64())
    k = pa.table({"t": [i for i, _ in known], "y": pa.array([i % 2 for i, _ in known], pa.int32()), "known": pa.array([s for _, s in known], kind)})
    a = pa.table({"identifier": [i for i, _ in asked], "asked": pa.array([s for _, s in asked], kind)})
    got = {r["identifier"]: (r["c"], r["t"], r["y"]) for r in evolve._best(k, a).to_pylist()}

    def correlation(x, y):
        n = max(len(x), len(y), 1)
        x, y = (np.pad(np.array(v, float), (0, n - len(v))) for v in (x, y))
        if x.max() == x.min() or y.max() == y.min():
            return 0.0
        return evolve.correlation(x, y)

    for i, s in asked:
        each = {t: correlation(s, other) for t, other in known}
        c, t, y = got[i]
        top = max(each.values())
        assert abs(c - top) < 1e-11 and y == t % 2
        assert t == min(u for u, v in each.items() if v > top - 1e-11)
    assert evolve._best(k.slice(0, 0), a).num_rows == 0
