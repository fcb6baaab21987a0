"""Best-fit packing by sums of squares.

A document's ids and an end id are cut only if they exceed a sequence; pieces of
``most`` tokens fill a sequence each.  Every other piece goes where the sum,
over all residual gaps, of the squared number of open sequences with that gap becomes
smallest: into an open sequence or a new one.  Keeping the counts of gaps apart
from equal makes every gap likely to be met by a later piece.

Pieces are dealt by a hash to shards of a bounded number of tokens, which are packed
independently, each in order of falling length.  A shard can leave a few
sequences part filled, out of about ``SHARD_TOKENS / most``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import save

SHARD_TOKENS = 64_000_000
SHARD_PIECES = 1_000_000  # of a shard, about: short texts are many rows to few tokens


def sum_of_squares(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset, number of sequences) for pieces of 1 to most tokens, placed in the order given.

    Ties go to the smallest gap, an open sequence before a new one.
    """
    count = np.zeros(most + 1, np.int64)  # open sequences by gap; a full one is closed
    free: list[list[int]] = [[] for _ in range(most + 1)]
    seq = np.empty(len(lengths), np.int64)
    off = np.empty(len(lengths), np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        at = -1
        if s < most:
            # moving a sequence from gap g to g-s changes the sum by 2*(N[g-s]-N[g]+1); closing it by 1-2*N[s]
            open_ = count[s : most + 1]
            cost = 2 * (count[: most + 1 - s] - open_ + 1)
            cost[0] = 1 - 2 * open_[0]
            cost[open_ == 0] = 1 << 60
            k = int(np.argmin(cost))
            new = 2 * int(count[most - s]) + 1
            if cost[k] <= new:
                at = s + k
        if at < 0:
            b, at = made, most
            made += 1
        else:
            b = free[at].pop()
            count[at] -= 1
        seq[i], off[i] = b, most - at
        if at > s:
            count[at - s] += 1
            free[at - s].append(b)
    return seq, off, made


def _ranges(texts: pa.Array, limit: int = 1 << 20):
    """Ranges of rows whose texts hold about limit bytes (one text at least), found without making strings of them."""
    end = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    lo = 0
    while lo < len(end):
        hi = max(lo + 1, int(np.searchsorted(end, limit + (end[lo - 1] if lo else 0), side="right")))
        yield lo, hi
        lo = hi


def _pieces(path: str, most: int, end_id: int):
    end = end_id.to_bytes(4, "little")

    def run(it):
        pa.default_memory_pool().release_unused()  # a worker that earlier stages used holds freed memory
        chunks = bpe.id_chunks(path)
        for batch in it:
            docs, texts = batch.column(0), batch.column(1)
            for lo, hi in _ranges(texts):
                out = []
                for d, ids in zip(docs[lo:hi].to_pylist(), chunks.of(texts[lo:hi].to_pylist()), strict=True):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), 4 * most)):
                        part = ids[a : a + 4 * most]
                        out.append((d, k, a // 4, len(part) // 4, zlib.crc32(part)))
                cols = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "piece", "start", "length", "ids_crc32"])

    return run


def _pack(most: int):
    def run(key, table):
        n = table.column("length").to_numpy()
        order = np.lexsort((table.column("piece").to_numpy(), table.column("id").fill_null(2**63 - 1).to_numpy(), -n))
        seq, off, _ = sum_of_squares(n[order], most)
        table = table.take(pa.array(order)).drop_columns(["shard"])
        return table.append_column("sequence_id", pa.array(seq + (key[0].as_py() << 40))).append_column("offset", pa.array(off))

    return run


def pack_documents(docs: DataFrame, vocabulary: str, most: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone; a null id is packed like any other and stays null;
    repeated rows are packed as often as they occur; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = save(docs.mapInArrow(_pieces(vocabulary, most, end_id), "id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.count("*").alias("rows")).first()
    shards = max(1, -(-total["tokens"] // SHARD_TOKENS), -(-total["rows"] // SHARD_PIECES))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece", F.monotonically_increasing_id()), F.lit(shards)))  # repeated rows are no hot group
    packed = dealt.groupBy("shard").applyInArrow(_pack(most), "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
