"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

Frequent pre-tokens are compiled into an automaton whose states share suffixes;
each transition carries how many entries come before it, so the sum along a path
numbers the entry, and a table gives the entry's ids.  The automaton is one block of
bytes that a worker maps into memory.  Batches of distinct pre-tokens walk it
together, one byte at a time; those it lacks are merged exactly.
"""

from __future__ import annotations

import hashlib
import mmap
import struct
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import save
from .shingles import batches

ENTRIES = 65_536
MOST_COUNTED = 300_000  # distinct chunks that a task counts before it hands them on
WORD_BYTES = 32  # longer pre-tokens aren't compiled


def compile_lexicon(entries: dict[bytes, bytes]) -> bytes:
    """The automaton of entries (word: ids as little-endian 32-bit) as one block of bytes.

    Words are added in byte order; a state whose words are all added is replaced by
    an equal one if there is any, so the automaton is minimal at the end.
    """
    words = sorted(w for w in entries if w)
    register: dict[tuple, int] = {}
    final: list[bool] = []
    edges: list[list[tuple[int, int]]] = []
    path: list[list] = [[False, []]]  # states of the last word: final, edges

    def freeze(state) -> int:
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(final)
            final.append(state[0])
            edges.append(state[1])
        return register[key]

    last = b""
    for w in words:
        k = 0
        while k < len(last) and k < len(w) and last[k] == w[k]:
            k += 1
        for d in range(len(last), k, -1):
            path[d - 1][1].append((last[d - 1], freeze(path[d])))
        del path[k + 1 :]
        path += [[False, []] for _ in range(len(w) - k)]
        path[-1][0] = True
        last = w
    for d in range(len(last), 0, -1):
        path[d - 1][1].append((last[d - 1], freeze(path[d])))
    root = freeze(path[0])
    n = [0] * len(final)  # entries below a state; its targets were frozen before it
    keys, targets, before = [], [], []
    for s in range(len(final)):
        n[s] = int(final[s])
        for b, t in edges[s]:
            keys.append(s << 8 | b)
            targets.append(t)
            before.append(n[s])
            n[s] += n[t]
    ids = [entries[w] for w in words]
    off = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype("<u4")
    parts = [np.array(keys, "<i8"), np.array(targets, "<i4"), np.array(before, "<i4"), np.array(final, "u1"), off, np.frombuffer(b"".join(ids), "<u4")]
    return struct.pack("<7q", root, *(len(p) for p in parts)) + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A compiled lexicon over any buffer, as a mapped file."""

    def __init__(self, block):
        root, *n = struct.unpack_from("<7q", block)
        at, arrays = 56, []
        for kind, k in zip(("<i8", "<i4", "<i4", "u1", "<u4", "<u4"), n, strict=True):
            arrays.append(np.frombuffer(block, kind, k, at))
            at += arrays[-1].nbytes
        self.root = root
        self.keys, self.targets, self.before, self.final, self.off, self.ids = arrays

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """Ids of each word, or None if it isn't an entry."""
        out: list[bytes | None] = [None] * len(words)
        if not len(self.keys) or not words:
            return out
        n = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        start = np.cumsum(n) - n
        live = np.flatnonzero((n > 0) & (n <= WORD_BYTES))
        state = np.full(len(live), self.root, np.int64)
        number = np.zeros(len(live), np.int64)
        for k in range(WORD_BYTES + 1):
            end = n[live] == k
            hit = np.flatnonzero(end & (self.final[state] == 1))
            for w, e in zip(live[hit].tolist(), number[hit].tolist(), strict=True):
                out[w] = self.ids[self.off[e] : self.off[e + 1]].tobytes()
            live, state, number = live[~end], state[~end], number[~end]
            if not len(live):
                break
            key = state << 8 | data[start[live] + k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at = live[ok], at[ok]
            state, number = self.targets[at].astype(np.int64), number[ok] + self.before[at]
        return out


def mapped(block: bytes) -> Lexicon:
    """The block in an unnamed file of this worker, mapped into memory; the file goes with the map."""
    with tempfile.TemporaryFile() as f:
        f.write(block)
        f.flush()
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def _words(path: str):
    """(word, count) of the pre-tokens of a task's texts; a part at a time, so memory is bounded."""

    def run(it):
        v = bpe.vocabulary(path)
        held: Counter[bytes] = Counter()

        def out():
            count: Counter[str] = Counter()
            for words, k in zip(v.split(list(held)), held.values(), strict=True):
                for w in words:
                    if isinstance(w, str) and len(w) <= WORD_BYTES:
                        count[w] += k
            held.clear()
            rows = [(b, n) for w, n in count.items() if len(b := w.encode()) <= WORD_BYTES]
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], names=["word", "n"])

        for batch in it:
            for t in batch.column(0).to_pylist():
                held.update(t.encode("utf-8", "replace").split() if t else ())
                if len(held) > MOST_COUNTED:
                    yield out()
        yield out()

    return run


def build_lexicon(docs: DataFrame, vocabulary: str, entries: int = ENTRIES, text_col: str = "text") -> bytes:
    """Compile the most frequent pre-tokens of all texts, ``entries`` at most.

    All words are counted.  How many words have each count gives the least count of which
    all words fit; words of that count or more, and of two at least, are taken, so no tie
    is cut and no more than ``entries`` words reach the driver, however many tasks count.
    Null and empty texts hold no words; a table without words gives an empty lexicon.
    """
    words = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_words(vocabulary), "word binary, n long")
    counts = save(words.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "words")
    sizes = counts.groupBy("n").agg(F.count("*").alias("k"))  # as many rows as there are different counts
    fits = sizes.withColumn("above", F.expr("sum(k) OVER (ORDER BY n DESC)")).where(F.col("above") <= entries).agg(F.min("n")).first()[0]
    found = sorted(bytes(r["word"]) for r in counts.where(F.col("n") >= fits).select("word").collect()) if fits is not None else []
    return compile_lexicon(dict(zip(found, bpe.vocabulary(vocabulary).merged_ids(found), strict=True)) if found else {})


class _Encoder:
    """Lexicon first, exact merges for what it lacks."""

    def __init__(self, path: str, block: bytes):
        self.v = bpe.vocabulary(path)
        self.lexicon = mapped(block)
        self.chunks = bpe.Chunks(self.v, self.ids_of, True)

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        out = self.lexicon.find(words)
        unseen = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(unseen, self.v.merged_ids([words[i] for i in unseen]) if unseen else (), strict=True):
            out[i] = ids
        return out


_held: dict = {}  # of a worker: the encoder of one lexicon


def encode(docs: DataFrame, vocabulary: str, lexicon: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ids (binary, little-endian unsigned 32-bit).

    Null texts are empty and have no ids; a null id stays null; repeated rows are encoded each; an
    empty table gives no rows; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    key = hashlib.blake2b(lexicon, digest_size=8).hexdigest()

    def run(it):
        if _held.get("key") != key:
            _held.update(key=key, encoder=_Encoder(vocabulary, sent.value))
        chunks = _held["encoder"].chunks
        for batch in it:
            texts = batch.column(1).to_pylist()
            for lo, hi in batches(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(chunks.of(texts[lo:hi]), pa.binary())], names=["id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """encoded with a column text: the text of its ids, as the library's decode gives it.

    Null ids give a null text, no ids an empty one; a column text is replaced, other columns stay; an empty
    table gives no rows.
    """
    encoded = encoded.drop("text")
    schema = T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())])

    def run(it):
        v = bpe.vocabulary(vocabulary)
        for batch in it:
            ids = batch.column(batch.schema.get_field_index("ids"))
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                text = pa.array([None if x is None else v.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in ids.slice(lo, 64).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*part.schema.names, "text"])

    return encoded.mapInArrow(run, schema)
