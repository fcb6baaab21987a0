"""Token counts: rank-synchronous array merging.

Pre-tokens of a batch are held as one ragged numpy array; each round applies the
lowest-rank pair of every sequence at once, and the symbols that survive are counted
(see ``bpe.Vocabulary.merge``).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .shingles import batches


def _counts(path: str):
    def run(it):
        chunks = bpe.count_chunks(path)
        for batch in it:
            texts = batch.column(1).to_pylist()
            n = [x for lo, hi in batches(texts) for x in chunks.of(texts[lo:hi])]
            size = [len(t.encode("utf-8", "replace")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty (0, 0, false); a null id stays null; repeated rows are counted each; an
    empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_counts(vocabulary), "id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id_col)
