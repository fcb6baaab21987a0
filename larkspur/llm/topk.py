"""Exact top-k search over an impact-ordered, score-at-a-time index.

Components are integers.  A block of vectors is indexed by dimension: postings are
sorted by component and cut into segments, each quantised to its least and greatest
component.  For a query, a segment's impact is the most that it can add to a score over what
every vector has in that dimension anyway.  All segments of all dimensions are taken by
falling impact, and each adds its impact to the accumulators of its postings.  When the next
segment's impact is T, a vector that was met in c of d dimensions scores at most
accumulator + (d - c) * T.  The best so far are scored exactly; once the vectors whose bound
reaches the k-th exact score are few, they alone can be members: they are scored
exactly, and the search stops.  It never stops on anything less.

Sums are exact: in 64-bit integers while no sum of products can leave them, else in
Python's integers, with bounds widened by what doubles can lose.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 16384  # vectors of an index block; what a query costs besides its postings is spread over them
ASKED = 4096  # queries that a task gets for a block
SEGMENTS = 24  # of a dimension, at most
ROUNDS = (0.7, 0.85, 1.0)  # shares of all postings after which the bound is tried
FEW = 4  # a search stops once a block's size / FEW vectors, or fewer, can be members
LARGEST = 2.0**53  # integers up to it are exact as doubles


class ImpactIndex:
    """Index of the rows of an integer matrix, with ids."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids.astype(np.int64), rows.astype(np.int64)
        n, d = rows.shape
        order = np.argsort(rows.T, axis=1, kind="stable").astype(np.int64)
        dims, begins, ends, lows, highs = [], [], [], [], []
        for j in range(d if n else 0):
            value = self.rows[order[j], j]
            width = max(1, (int(value[-1]) - int(value[0])) // SEGMENTS + 1)
            cut = np.unique(np.searchsorted(value, np.minimum(int(value[0]) + width * np.arange(SEGMENTS + 1, dtype=object), 2**62).astype(np.int64)))
            cut = np.unique(np.concatenate([[0], cut, [n]]))
            dims += [j] * (len(cut) - 1)
            begins += cut[:-1].tolist()
            ends += cut[1:].tolist()
            lows += value[cut[:-1]].tolist()
            highs += value[cut[1:] - 1].tolist()
        self.dim, self.begin, self.end = np.array(dims, np.int64), np.array(begins, np.int64), np.array(ends, np.int64)
        self.low, self.high = np.array(lows, np.int64), np.array(highs, np.int64)
        self.real = self.rows.astype(float)
        self.postings = order.ravel()  # dimension after dimension
        self.at = np.empty(n * d, np.int64)  # a search writes its postings here, so that it allocates nothing large
        self.most = np.abs(self.real).max(initial=0)

    def exact(self, some: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Scores of some rows."""
        most = float(np.abs(q.astype(float)).max(initial=0)) * self.most * max(1, len(q))
        if most < LARGEST:  # every partial sum is a whole number that a double holds
            return (self.real[some] @ q.astype(float)).astype(np.int64)
        if most < 2.0**62:
            return self.rows[some] @ q
        return self.rows[some].astype(object) @ q.astype(object)

    def search(self, q: np.ndarray, k: int, skip: int | None = None) -> list[tuple[int, int]]:
        """The k best (id, score), ties to the smaller id; rows with the id skip take no part."""
        n, d = self.rows.shape
        q = q.astype(np.int64)
        out = np.flatnonzero(self.ids == skip) if skip is not None else np.zeros(0, np.int64)
        k = min(k, n - len(out))
        if k <= 0:
            return []
        x = q[self.dim].astype(float)
        worth = np.where(x > 0, x * self.high, x * self.low)  # of a posting, at most
        least = np.full(d, np.inf)
        np.minimum.at(least, self.dim, worth)
        impact = worth - least[self.dim]
        segments = np.flatnonzero(x != 0)
        segments = segments[np.argsort(-impact[segments], kind="stable")]
        used = len(np.unique(self.dim[segments]))
        base = float(least[q != 0].sum())
        lost = 0.0 if np.abs(worth).max(initial=0) * (d + 1) < LARGEST else 1e-12 * (d + 2) * float(np.abs(worth).max()) * (d + 1)
        size = self.end[segments] - self.begin[segments]
        after = np.cumsum(size)
        # impact and count share one sum, the count in its lowest bits, while a double holds both exactly
        step = 1 << used.bit_length()
        joint = float(impact.max(initial=0)) * (used + 1) * step < LARGEST
        weight = impact * step + 1 if joint else impact
        acc, met, both = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        done = 0
        for share in ROUNDS:
            upto = len(segments) if share == ROUNDS[-1] else int(np.searchsorted(after, share * n * used))
            now = segments[done:upto]
            if len(now):
                first = self.dim[now] * n + self.begin[now]
                at = self.at[: int(size[done:upto].sum())]
                np.concatenate([self.postings[a:z] for a, z in zip(first.tolist(), (first + size[done:upto]).tolist(), strict=True)], out=at)
                added = np.bincount(at, np.repeat(weight[now], size[done:upto]), n)
                if joint:
                    both += added.astype(np.int64)
                    met = both & (step - 1)
                    acc = both >> used.bit_length()
                else:
                    acc += added
                    met += np.bincount(at, minlength=n)
            done = upto
            rest = impact[segments[done]] if done < len(segments) else 0.0
            bound = acc + (used - met) * rest + (base + lost)
            bound[out] = -np.inf
            few = min(n, 4 * k + len(out))
            some = np.argpartition(bound, n - few)[n - few :]
            some = some[bound[some] > -np.inf]
            floor = np.sort(self.exact(some, q))[::-1][k - 1] if len(some) >= k else None
            may = np.flatnonzero(bound >= float(floor) - lost) if floor is not None else np.flatnonzero(bound > -np.inf)
            if done == len(segments) or len(may) <= max(8 * k, n // FEW):
                score = self.exact(may, q)
                best = np.lexsort((self.ids[may], -score))[:k] if score.dtype != object else sorted(range(len(may)), key=lambda i: (-score[i], self.ids[may[i]]))[:k]
                return [(int(self.ids[may[b]]), int(score[b])) for b in best]
        raise AssertionError("the last round ends the search")


def _matrix(col, width: int) -> np.ndarray:
    """Rows of a list column, zeros after their end."""
    n = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy()
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _search(k: int):
    def run(data, asked):
        found = []
        if data.num_rows and asked.num_rows:
            v, q = data.column("v").combine_chunks(), asked.column("v").combine_chunks()
            width = max(1, *(int(np.diff(c.offsets.to_numpy()).max()) for c in (v, q)))
            ids, copies = data.column("vec_id").to_numpy(), data.column("copies").to_numpy()
            order = np.argsort(ids, kind="stable")
            index = ImpactIndex(ids[order], _matrix(v, width)[order])
            of = dict(zip(ids[order].tolist(), copies[order].tolist(), strict=True)) if copies.max() > 1 else {}
            for i, c, x in zip(asked.column("vec_id").to_pylist(), asked.column("copies").to_pylist(), _matrix(q, width), strict=True):
                rows: list[tuple] = []
                for got, score in index.search(x, k, i):
                    if not -(2**63) <= score < 2**63:
                        raise OverflowError(f"the score of {i} and {got} is beyond 64 bits")
                    rows += [(i, got, score)] * min(k, c * of.get(got, 1))
                found += rows[: k * c]
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table([pa.array(list(c), pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component x, as double.

    Rows with a null id, and vectors that are null or hold a null or non-finite component, are
    left out; an empty vector stays, with a score of 0.  A finite component whose floor is beyond
    2**53, from where doubles are no longer whole numbers apart, is an error, not left out.
    """
    v = F.col(vector_col).cast(T.ArrayType(T.DoubleType()))
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine)
    whole = lambda x: F.when(F.abs(x * scale) <= F.lit(LARGEST), F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is beyond 2**53 when scaled")).cast("long"))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: whole(x).cast("long")).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k greatest integer inner products.

    Both inputs have (vec_id, v: array of long).  Candidates are all vectors but the
    rows with the query's own id; ties go to the smaller id; fewer than k candidates
    give fewer rows; vectors of other lengths are taken as followed by zeros; empty tables give no rows.
    Repeated rows count as rows each, on both sides; equal ones are counted before they are dealt, so
    that they are no hot group.  A score beyond 64 bits is an error.
    Vectors are dealt to index blocks of about ``BLOCK``, queries to groups of about ``ASKED``; each pair of a
    block and a group is one task's work, and a query's best of each block are merged.
    """
    known = vectors.groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    asked = queries.groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    blocks, groups = max(1, -(-vectors.count() // BLOCK)), max(1, -(-queries.count() // ASKED))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    at = F.xxhash64("vec_id", "v")
    dealt = known.withColumn("block", F.pmod(at, F.lit(blocks))).withColumn("group", each(groups))
    given = asked.withColumn("group", F.pmod(at, F.lit(groups))).withColumn("block", each(blocks))
    found = dealt.groupBy("block", "group").cogroup(given.groupBy("block", "group")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    return found.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)")).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
