"""What a task of the n-gram join holds at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from larkspur.llm import jaccard_join


class Sent:
    value = b"\xff" * 8


def test_texts_of_a_batch_become_strings_a_megabyte_at_a_time(monkeypatch):
    sizes, plain = [], jaccard_join.shingle_sets
    monkeypatch.setattr(jaccard_join, "shingle_sets", lambda texts, n: sizes.append(sum(map(len, texts))) or plain(texts, n))
    texts = [f"{i} " * 100_000 for i in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64())] * 2 + [pa.array(texts)], names=["id", "key", "text"])
    rows = jaccard_join._sets(batch, 5)
    next(rows)
    assert sum(sizes) < 2 << 20  # the others aren't strings yet
    assert [d for (d, _), _ in rows] == list(range(1, 20)) and sum(sizes) == sum(map(len, texts))


def test_whole_sets_leave_a_task_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(jaccard_join, "HELD", 100)
    texts = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(10)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(12), pa.int64())] * 2 + [pa.array(texts)], names=["id", "key", "text"])
    made = list(jaccard_join._rows_of(5, Sent)([batch]))
    assert len(made) >= 5 and max(b.num_rows for b in made) <= 2
    rows = [r for b in made for r in b.to_pylist()]
    assert [r["least"] for r in rows] == list(range(10))
    assert all(len(np.frombuffer(r["data"], np.uint64)) == 56 for r in rows)
