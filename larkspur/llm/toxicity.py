"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the presence of its words, pairs of adjacent words and
pairs with one word between, each hashed to one of ``2**BITS`` coordinates.  Training
goes over a bounded sample of labelled rows, one row at a time, with a rate for each
coordinate and L1 sparsity; only the weights that are not zero are
broadcast, ``2**BITS`` of them at most.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import save
from .shingles import _COEF, batches, mix, word_hashes

BITS = 20
SAMPLE = 16_384  # labelled rows that training reads at most
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.05


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, coordinate) of every n-gram of the texts, repeats included."""
    bpe.release()
    words, off = word_hashes(texts, letters=True)
    text = np.repeat(np.arange(len(texts)), np.diff(off))
    with np.errstate(over="ignore"):
        one = mix(words * _COEF[40])
        two = mix(words[:-1] * _COEF[41] + words[1:] * _COEF[42])
        skip = mix(words[:-2] * _COEF[43] + words[2:] * _COEF[44])
    a, b = text[:-1] == text[1:], text[:-2] == text[2:]
    at = np.concatenate([one, two[a], skip[b]]) >> np.uint64(64 - BITS)
    return np.concatenate([text, text[:-1][a], text[:-2][b]]), at.astype(np.int64)


def _present(it):
    """(key, y, coordinates) of each row of (key, y, text)."""
    for batch in it:
        key, y, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        for lo, hi in batches(texts):
            text, at = features(texts[lo:hi])
            both = np.unique((text << BITS) + at)
            cut = np.searchsorted(both, np.arange(hi - lo + 1) << BITS)
            data = (both & ((1 << BITS) - 1)).astype("<u4")
            yield pa.RecordBatch.from_arrays([key.slice(lo, hi - lo), y.slice(lo, hi - lo), pa.array([data[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["key", "y", "data"])


def ftrl(rows: list[tuple[float, np.ndarray]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights, bias) after epochs over rows of (label, coordinates), in the order given."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weight(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    l1 = np.zeros(1)
    for _ in range(epochs):
        for y, at in rows:
            at = np.append(at, np.uint32(bias))
            l1 = np.full(len(at), L1)
            l1[-1] = 0
            w = weight(z[at], n[at], l1)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
            n[at] = new
    l1 = np.full(len(z), L1)
    l1[-1] = 0
    w = weight(z, n, l1)
    return w[:-1], float(w[-1])


def _train(sample: int):
    """The model of the ``sample`` rows of least key; ids that several rows have don't lengthen the sample."""

    def run(it):
        read = ((k, float(y), np.frombuffer(d, "<u4")) for batch in it for k, y, d in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        rows = heapq.nsmallest(sample, read, key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes()))
        if not rows:
            return
        w, b = ftrl([r[1:] for r in rows])
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, 1 << BITS)), pa.array(np.append(w[at], b))], names=["at", "w"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights that are not zero; coordinate ``2**BITS`` is the bias.

    labels has one row per labelled document (of several the greatest label counts;
    null ids or labels are ignored).  Of all of them the ``sample`` with the least hash of
    their id train, or all if fewer.  Without any, only a bias of zero comes back.
    """
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = one.withColumn("key", F.xxhash64("id", F.lit(7))).orderBy("key").limit(sample)
    chosen = save(chosen, "sample")  # ``sample`` rows of three numbers: small enough to broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("key", "y", "text")
    found = rows.mapInArrow(_present, "key long, y int, data binary").repartition(1).mapInArrow(_train(sample), "at long, w double").toPandas()
    if not len(found):
        return np.array([1 << BITS]), np.zeros(1)
    return found["at"].to_numpy(), found["w"].to_numpy()


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1: the chance that the label is 1.

    Whole texts are scored; null, empty and wordless ones get the bias alone.  An existing
    column of the same name is replaced.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model[0].astype(np.int64), model[1].astype(np.float64)))

    def scores(it):
        at, w = sent.value
        dense = np.zeros((1 << BITS) + 1)
        dense[at] = w
        for texts in it:
            texts = texts.tolist()
            out = np.full(len(texts), dense[-1])
            for lo, hi in batches(texts):
                text, at = features(texts[lo:hi])
                hit = np.flatnonzero(dense[at])
                both = np.unique((text[hit] << BITS) + at[hit])
                out[lo:hi] += np.bincount(both >> BITS, weights=dense[both & ((1 << BITS) - 1)], minlength=hi - lo)
            yield _series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return docs.withColumn(score_col, _scalar_iter(scores)(F.col(text_col).cast("string")))


def _series(x):
    import pandas as pd

    return pd.Series(x)


def _scalar_iter(f):
    from pyspark.sql.pandas.functions import PandasUDFType

    return F.pandas_udf(f, "double", PandasUDFType.SCALAR_ITER)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """docs with held_out, score and predicted; labels of held-out documents never train.

    held_out: crc32 of the id as text is 2 mod 4, false for a null id.  predicted: 1 where score >= threshold.
    Null, empty and wordless texts are scored by the bias alone; repeated rows get the same score each; an
    empty table gives no rows; columns with the names of results are replaced, all others stay.
    """
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit_toxicity(docs, labels.where(~held), sample=sample)
    out = score_toxicity(docs.withColumn("held_out", F.coalesce(held, F.lit(False))), model)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
