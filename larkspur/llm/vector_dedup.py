"""Near copies among embeddings: a pigeonhole join over blocks of rotated vectors.

Vectors of one label are linked when their cosine is at least a threshold, which for unit vectors
is a squared distance of at most 2 - 2 * threshold.  Unit vectors are rotated (random signs, then
a Hadamard transform) and their coordinates split into blocks.  Each block gets the share of the
squared distance that its width has of all coordinates, so a linked pair is within the share in
one block at least.  Each block is a range join: its first ``AXES`` coordinates are cut into cells
no narrower than the range, and a vector goes to its own cell and to the one below in each axis whose
border is near enough, so two vectors within the range meet in the lower of their cells.  A pair
within the range in a block is a candidate; the union of the blocks' candidates is taken by letting the
first block in which a pair is within the range have it.  Candidates are verified by their cosine in
double precision.  Only counts of links and spanning links leave a task, never pairs.

The rotation is made of additions and subtractions in a fixed order, so every task gets the same
bits for a vector, and blocks and cells agree on who has a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SMALL, components, discard, lookup, save

BLOCKS = 4  # that the coordinates are split into
AXES = 2  # coordinates of a block that are cut into cells
FULL = 2048  # vectors that a cell has on average, at least
CHUNK = 4096  # vectors of a cell that one task compares with as many
TILE = 256  # rows and columns that are compared at a time
SLACK = 1e-9  # by which ranges are widened, for what doubles lose
CLOSE = 1e-12  # cosines this near to the threshold are computed again in a fixed order


def rotate(vectors: np.ndarray) -> np.ndarray:
    """Rows times random signs and an orthonormal Hadamard matrix, padded with zeros to a power of two."""
    n, d = vectors.shape
    width = 1 << max(0, d - 1).bit_length()
    out = np.zeros((n, width))
    out[:, :d] = vectors
    out *= np.where(np.random.default_rng(1).random(width) < 0.5, -1.0, 1.0)
    half = 1
    while half < width:
        pairs = out.reshape(n, width // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return out / np.sqrt(width)


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; their lengths are summed column by column, so they don't depend on what stands beside a row."""
    big = np.abs(vectors).max(axis=1, initial=0)
    scaled = vectors / np.where(big > 0, big, 1)[:, None]
    square = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        square += scaled[:, j] * scaled[:, j]
    return scaled / np.sqrt(np.where(square > 0, square, 1))[:, None]


class Blocks:
    """The blocks of a width, and the squared range of each for a threshold."""

    def __init__(self, width: int, threshold: float, blocks: int = BLOCKS):
        self.cuts = np.unique(np.linspace(0, width, min(blocks, width) + 1).astype(int))
        self.budget = (2 - 2 * threshold) * np.diff(self.cuts) / width + SLACK

    def __len__(self) -> int:
        return len(self.budget)

    def within(self, rows: np.ndarray, s: np.ndarray, t: np.ndarray, b: int) -> np.ndarray:
        """Whether the rows s and t are within block b's range, summed in a fixed order."""
        far = np.zeros(len(s))
        for j in range(self.cuts[b], self.cuts[b + 1]):
            far += (rows[s, j] - rows[t, j]) ** 2
        return far <= self.budget[b]

    def cells(self, rows: np.ndarray, b: int, count: np.ndarray, full: int = FULL) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row in each axis of block b, and whether it also goes to the one below.

        count: how many vectors a row's label has; the more, the narrower the cells, down to the range.
        """
        reach = np.sqrt(self.budget[b])
        axes = rows[:, self.cuts[b] : min(self.cuts[b] + AXES, self.cuts[b + 1])]
        parts = np.maximum(1.0, count / full) ** (1 / axes.shape[1])
        spread = 4 / np.sqrt(rows.shape[1])  # most coordinates of unit vectors are within half of it of zero
        width = np.maximum(reach * (1 + SLACK), np.where(parts > 1, spread / parts, 4.0))[:, None]
        at = np.floor(axes / width + 0.5)
        return at.astype(np.int64), axes - (at - 0.5) * width <= reach * (1 + SLACK)


def _rows(col, width: int | None = None) -> np.ndarray:
    """Rows of a list column as doubles, zeros after their end."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), width or max(1, int(n.max(initial=1)))))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _deal(threshold: float, width: int, full: int, kept: list[str]):
    """The kept columns of each vector for each block and cell to which it goes, and the cell."""

    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            rows = rotate(units(_rows(batch.column("v"), width)))
            blocks = Blocks(rows.shape[1], threshold)
            count = batch.column("of_label").to_numpy()
            for b in range(len(blocks)):
                at, low = blocks.cells(rows, b, count, full)
                for step in range(1 << at.shape[1]):
                    down = np.array([step >> k & 1 for k in range(at.shape[1])])
                    goes = np.flatnonzero((low | (down == 0)).all(axis=1))
                    cell = (at - down)[goes]
                    got = batch.select(kept).take(pa.array(goes))
                    place = [pa.array(np.full(len(goes), b, np.int32)), pa.array(cell[:, 0]), pa.array(cell[:, -1])]
                    yield pa.RecordBatch.from_arrays([*got.columns, *place], names=[*kept, "block", "x", "y"])

    return run


def _forest(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what root, which is changed, hadn't joined yet."""
    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = x, y
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        while root[q] != q:
            root[q] = root[root[q]]
            q = root[q]
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _compare(threshold: float, width: int, full: int):
    """Links of one cell, or between two chunks of it: (node, null, number of links) and spanning links (a, b, null)."""

    def run(table):
        node, label = table.column("node").to_numpy(), table.column("label").to_numpy()
        # sorted, so that a task that is run again does the same; sums don't depend on it
        order = np.lexsort((node, label, table.column("chunk").to_numpy()))
        table = table.take(pa.array(order))
        node, label = node[order], label[order]
        b, cell = table.column("block")[0].as_py(), np.array([table.column("x")[0].as_py(), table.column("y")[0].as_py()])
        unit = units(_rows(table.column("v"), width))
        rows = rotate(unit)
        blocks = Blocks(rows.shape[1], threshold)
        home, _ = blocks.cells(rows, b, table.column("of_label").to_numpy(), full)
        copies = table.column("copies").to_numpy()
        chunk = table.column("chunk").to_numpy()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        left, right = (np.flatnonzero(chunk == lo), np.flatnonzero(chunk == hi)) if lo != hi else (np.arange(len(node)),) * 2
        part = rows[:, blocks.cuts[b] : blocks.cuts[b + 1]]
        square = (part * part).sum(axis=1)
        links, root, edges = np.zeros(len(node), np.int64), np.arange(len(node)), []
        for i in range(0, len(left), TILE):
            p = left[i : i + TILE]
            for j in range(i if lo == hi else 0, len(right), TILE):
                q = right[j : j + TILE]
                far = square[p][:, None] + square[q][None, :] - 2 * (part[p] @ part[q].T)
                s, t = np.nonzero(far <= blocks.budget[b] + SLACK)
                s, t = p[s], q[t]
                fine = (s < t if lo == hi else s != t) & (label[s] == label[t]) & (np.minimum(home[s], home[t]) == cell[: home.shape[1]]).all(axis=1)
                s, t = s[fine], t[fine]
                fine = blocks.within(rows, s, t, b)
                for before in range(b):
                    fine &= ~blocks.within(rows, s, t, before)
                s, t = s[fine], t[fine]
                cos = np.einsum("ij,ij->i", unit[s], unit[t])
                near = np.abs(cos - threshold) <= CLOSE
                if near.any():
                    exact = np.zeros(int(near.sum()))
                    for k in range(unit.shape[1]):
                        exact += unit[s[near], k] * unit[t[near], k]
                    cos[near] = exact
                s, t = s[cos >= threshold], t[cos >= threshold]
                links += np.bincount(s, copies[t], len(node)).astype(np.int64) + np.bincount(t, copies[s], len(node)).astype(np.int64)
                # a link inside what is joined already adds nothing
                while len(s):
                    while (root[root] != root).any():
                        root = root[root]
                    new = root[s] != root[t]
                    s, t = s[new], t[new]
                    edges += _forest(s[:TILE], t[:TILE], root)
                    s, t = s[TILE:], t[TILE:]
        some = np.flatnonzero(links)
        a = np.concatenate([node[some], node[np.array([e[0] for e in edges], int)]])
        z = np.concatenate([np.zeros(len(some), np.int64), node[np.array([e[1] for e in edges], int)]])
        n = np.concatenate([links[some], np.zeros(len(edges), np.int64)])
        return pa.table([pa.array(a), pa.array(z, mask=np.arange(len(z)) < len(some)), pa.array(n, mask=np.arange(len(n)) >= len(some))], names=["a", "b", "n"])

    return run


def near_copies(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", full: int = FULL) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row: links to rows of the same label with a cosine of at least the threshold.

    A vector that is null, empty, zero or holds a null or non-finite component, and one without a label, links
    with nothing; so does nothing else with it.  It is a component by itself, and kept.  Shorter vectors are
    taken as followed by zeros.  Equal vectors of a label are linked without being compared
    (found by a 64-bit hash of label and components), so repeats make no hot group: a row counts each other
    row.  Repeated ids are rows each, a null id stays (as a component's least id only if there is no other).
    An empty table gives no rows; other columns are ignored.  The threshold is over 0 and at most 1.

    A cell of over ``CHUNK`` vectors is compared by pairs of chunks, each a task of its own, so m near copies cost
    m * m / 2 products spread over tasks, and no task holds more than two chunks.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    spark = vectors.sparkSession
    v = F.col(vector_col).cast(T.ArrayType(T.DoubleType()))
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    fine = F.col(label_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.when(fine, F.xxhash64(F.col(label_col).cast("string"), F.transform(v, lambda x: x + F.lit(0.0)))).alias("node"),
        F.when(fine, F.xxhash64(F.col(label_col).cast("string"))).alias("label"),
        F.when(fine, F.col(vector_col) if single else v).alias("v"),
    )
    known = save(rows.where("node IS NOT NULL").groupBy("node").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least")), "vectors")
    labels = known.groupBy("label").agg(F.count("*").alias("of_label"))
    width = known.agg(F.max(F.size("v"))).first()[0] or 1
    counted = lookup(known.select("label", "node", "v", "copies"), labels.withColumn("weight", F.col("of_label")), "label", "weight")
    list_type = "array<float>" if single else "array<double>"
    place = ["label", "block", "x", "y"]
    dealt = counted.mapInArrow(_deal(threshold, width, full, counted.columns), f"label long, node long, v {list_type}, copies long, of_label long, block int, x long, y long")
    sizes = counted.mapInArrow(_deal(threshold, width, full, ["label"]), "label long, block int, x long, y long").groupBy(*place).count().where(F.col("count") > CHUNK)
    large = sizes.select(*place, F.ceil(F.col("count") / CHUNK).alias("chunks"))
    held = save(large, "cells")
    split = dealt.join(F.broadcast(held) if held.count() <= SMALL else held, place, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)).cast("long"))
    chunk = split.withColumn("chunk", F.pmod(F.col("node"), F.col("chunks")))
    paired = chunk.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other"))
    found = save(paired.drop("other", "chunks").groupBy(*place, "lo", "hi").applyInArrow(_compare(threshold, width, full), "a long, b long, n long"), "links")
    roots = components(found.where("b IS NOT NULL").select("a", "b"), "copies")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    both = known.select("node", "copies", "least").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = both.groupBy("root").agg(F.min("least").alias("component"))
    nodes = save(both.join(smallest, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component", "copies"), "nodes")
    discard(known, held, found, roots)
    out = lookup(rows.select("vec_id", "node"), nodes, "node", "copies")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
