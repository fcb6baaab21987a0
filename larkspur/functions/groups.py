"""Groups that are worked on by Arrow batches: rows of a key are dealt to one task and sorted there, and are never gathered by an aggregate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


BYTES = 4 << 20  # of rows that are worked on at a time, or a group if it has more


def whole(batches, key: str):
    """(table, first row of each of its groups) of batches sorted by key; the last group waits for the rest of it."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size < BYTES:
            continue
        table, first = _table(waiting, key)
        if first[-1]:  # groups before the last are whole
            yield table.slice(0, first[-1]), first[:-1]
        waiting = table.slice(first[-1]).to_batches()
        size = 0
    if waiting:
        yield _table(waiting, key)


def _steps(keys) -> np.ndarray:
    """Rows whose key isn't that of the row before, without the first; null is a key."""
    return np.flatnonzero(np.diff(keys.dictionary_encode(null_encoding="encode").indices.to_numpy())) + 1


def _table(batches: list[pa.RecordBatch], key: str) -> tuple[pa.Table, np.ndarray]:
    made = pa.Table.from_batches(batches).combine_chunks()
    return made, np.concatenate([[0], _steps(made.column(key).combine_chunks())])


def lists(table: pa.Table, first: np.ndarray, name: str) -> pa.ListArray:
    """A group's values of a column, without nulls, as a list."""
    values = table.column(name).combine_chunks()
    before = np.concatenate([[0], np.cumsum(pc.is_valid(values).to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(np.append(before[first], before[-1]).astype(np.int32)), values.drop_null())


def by_group(df: DataFrame, key: str, of, schema: str) -> DataFrame:
    """Rows that of(keys of groups, lists of each other column's values) gives as record batches; keys are those of many groups at a time."""
    names = [c for c in df.columns if c != key]

    def run(batches):
        for table, first in whole(batches, key):
            yield from of(table.column(key).combine_chunks().take(pa.array(first)), *(lists(table, first, n) for n in names))

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)
