"""How sources differ from one another and from their language, by their terms.

Texts are tokenised as bytes: the UTF-8 of many texts stands in one buffer, a table of 256 entries
lower-cases A-Z and marks what belongs to a term, and boundaries are where the mark changes or a text begins.
Slices are grouped by their XXH64, taken for all slices of a buffer at once, and each slice is compared byte
by byte with the first of its group; slices that differ though their hashes agree are grouped by their bytes.

Counts are summed by Spark.  Kept terms are dealt to blocks by a hash; a block of a language holds them as a sparse
matrix by source, in which divergences of a source from all others are sums over segments (``reduceat``).
All arithmetic is on integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lookup, save

LEAST_DOCS = 3  # documents of a language that a kept term is in
UNIT = 1_000_000_000  # shares are in parts of it
TOP = 200  # terms of a source that are reported
CHUNK = 6_000_000  # bytes that are tokenised at a time
ENTRIES = 100_000  # counts of a block

#: Lower-cased bytes of terms (ASCII letters, and all bytes over 127); 0 stands between terms.
TABLE = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 0 for b in range(256)], np.uint8)

# fixed values: the primes of XXH64
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 of slices of data, which has 8 more bytes after the last slice.

    Slices of under 32 bytes are hashed together, step by step; longer ones, which are few, one by one.
    """
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    halves = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    with np.errstate(over="ignore"):
        h = _P5 + size.astype(np.uint64)
        short = size < 32
        for k in range(3):
            at = np.flatnonzero(short & (size >= 8 * k + 8))
            if len(at):
                lane = _turned(words[start[at] + 8 * k] * _P2, 31) * _P1
                h[at] = _turned(h[at] ^ lane, 27) * _P1 + _P4
        at = np.flatnonzero(short & (size % 8 >= 4))
        done = size // 8 * 8
        h[at] = _turned(h[at] ^ (halves[start[at] + done[at]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        done = done + 4 * (size % 8 >= 4)
        for k in range(3):
            at = np.flatnonzero(short & (size - done > k))
            h[at] = _turned(h[at] ^ (data[start[at] + done[at] + k].astype(np.uint64) * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        h ^= h >> np.uint64(32)
    for i in np.flatnonzero(~short):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]].tobytes())
    return h


def slices(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the terms in data, which is mapped by ``TABLE``; no term goes over a begin of a text."""
    term = data != 0
    first = np.zeros(len(data) + 1, bool)
    first[begins] = True
    before = np.concatenate([[False], term])
    after = np.concatenate([term, [False]])
    edge = (before != after) | (first & before & after)
    at = np.flatnonzero(edge)
    start = at[after[at]]
    return start, at[before[at]] - start


def group_slices(data: np.ndarray, start: np.ndarray, size: np.ndarray, of: np.ndarray, hashes: Callable = xxh64) -> tuple[np.ndarray, np.ndarray]:
    """Order of the slices in which equal ones of equal ``of`` stand together, and where groups begin in it.

    data has 8 more bytes after the last slice.
    """
    with np.errstate(over="ignore"):
        key = hashes(data, start, size) ^ (of.astype(np.uint64) * _P3)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    head = order[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
    same = (size[order] == size[head]) & (of[order] == of[head])
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    k = 0
    todo = np.flatnonzero(same & (order != head))
    while len(todo):
        left = size[order[todo]] - 8 * k
        todo, left = todo[left > 0], left[left > 0]
        differ = words[start[order[todo]] + 8 * k] ^ words[start[head[todo]] + 8 * k]
        mask = np.where(left >= 8, np.uint64(2**64 - 1), (np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1))
        same[todo[(differ & mask) != 0]] = False
        k += 1
    if not same.all():
        odd = order[~same]
        names = [(int(of[i]), data[start[i] : start[i] + size[i]].tobytes()) for i in odd]
        sort = sorted(range(len(odd)), key=lambda i: (names[i], odd[i]))
        fresh = [not i or names[sort[i]] != names[sort[i - 1]] for i in range(len(sort))]
        order, first = np.concatenate([order[same], odd[sort]]), np.concatenate([first[same], fresh])
    return order, np.flatnonzero(first)


def _texts(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The slices as strings."""
    end = np.cumsum(size)
    flat = data[np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)]
    offsets = np.concatenate([[0], end]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())])


def count_slices(raw: np.ndarray, ends: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Group, term, occurrences and texts of the terms of texts that end at ends in raw."""
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    data = TABLE[raw]
    start, size = slices(data, begins)
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    text = np.searchsorted(ends, start, side="right")
    of = group[text]
    order, at = group_slices(data, start, size, of)
    n = np.diff(np.concatenate([at, [len(order)]]))
    seen = text[order]  # rising within a group, as the sort is stable
    new = np.concatenate([[True], seen[1:] != seen[:-1]]) if len(order) else np.zeros(0, bool)
    new[at] = True
    docs = np.add.reduceat(new.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    head = order[at]
    return of[head], _texts(data, start[head], size[head]), n, docs


def _pieces(raw: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """raw cut between terms into pieces of about most bytes."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + most)
        while end < len(raw) and TABLE[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end


def _counts(most: int):
    names = ["lang", "source", "term", "n", "docs"]

    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            keys = pa.table([batch.column("lang"), batch.column("source")], names=["lang", "source"]).append_column("row", pa.array(np.arange(batch.num_rows)))
            found = keys.group_by(["lang", "source"], use_threads=False).aggregate([("row", "list")])
            group = np.empty(batch.num_rows, np.int64)
            for g, rows in enumerate(found.column("row_list")):
                group[rows.values.to_numpy()] = g
            lang, source = found.column("lang").combine_chunks(), found.column("source").combine_chunks()
            zero = pa.array(np.zeros(len(lang), np.int64))
            yield pa.RecordBatch.from_arrays([lang, source, pa.nulls(len(lang), pa.string()), zero, zero], names=names)
            col = batch.column("text")
            offsets = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
            raw = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
            lo = 0
            while lo < len(col):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
                part = raw[offsets[lo] : offsets[hi]]
                if hi == lo + 1 and len(part) > most:
                    held: dict[str, int] = {}
                    for piece in _pieces(part, most):
                        _, terms, n, _ = count_slices(piece, np.array([len(piece)]), np.zeros(1, np.int64))
                        for t, c in zip(terms.to_pylist(), n.tolist(), strict=True):
                            held[t] = held.get(t, 0) + c
                    of, terms, n, docs = np.full(len(held), group[lo]), pa.array(list(held), pa.string()), np.array(list(held.values()), np.int64), np.ones(len(held), np.int64)
                else:
                    of, terms, n, docs = count_slices(part, offsets[lo + 1 : hi + 1] - offsets[lo], group[lo:hi])
                at = pa.array(of)
                yield pa.RecordBatch.from_arrays([lang.take(at), source.take(at), terms, pa.array(n.astype(np.int64)), pa.array(docs)], names=names)
                lo = hi

    return run


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(``UNIT`` * count / total), by long division three digits at a time, so nothing leaves 64 bits (totals under 9e15)."""
    whole, rest = np.divmod(np.asarray(count, np.int64), total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return 1 + whole


def far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / q); shares are at most ``UNIT`` + 1, so squares are within 64 bits."""
    return (p - q) * (p - q) // q


def _diverge(top: int):
    def run(entries: pa.Table, groups: pa.Table) -> pa.Table:
        groups = groups.sort_by("source")
        sources, total, kept = groups.column("source").combine_chunks(), groups.column("total").to_numpy(), groups.column("kept")[0].as_py()
        lang, lang_total = groups.column("lang")[0].as_py(), groups.column("lang_total")[0].as_py()
        many = len(sources)
        # dictionaries in the order of UTF-8
        terms = pc.unique(entries.column("term")).sort() if entries.num_rows else pa.array([], pa.string())
        t = pc.index_in(entries.column("term"), terms).to_numpy().astype(np.int64) if entries.num_rows else np.zeros(0, np.int64)
        s = pc.index_in(entries.column("source"), sources).to_numpy().astype(np.int64) if entries.num_rows else np.zeros(0, np.int64)
        n = entries.column("n").to_numpy()
        order = np.lexsort((t, s))
        t, s, n = t[order], s[order], n[order]
        ends = np.searchsorted(s, np.arange(many + 1))
        filled = np.flatnonzero(np.diff(ends))
        pairs = np.zeros((many, many), np.int64)
        rows: list[np.ndarray] = []
        values: list[np.ndarray] = []
        items: list[np.ndarray] = []
        if kept:
            p, zero = share(n + 1, total[s] + kept), share(np.ones(many, np.int64), total + kept)
            of_lang = np.zeros(len(terms), np.int64)
            np.add.at(of_lang, t, n)
            q = share(of_lang + 1, lang_total + kept)[t]
            least = far(np.zeros(0, np.int64), np.zeros(0, np.int64)) if not len(s) else None
            dense = np.empty(len(terms), np.int64)
            for g in range(many):
                a, z = ends[g], ends[g + 1]
                dense[:] = zero[g]
                dense[t[a:z]] = p[a:z]
                # as if no source had any term, then what the terms that a source has change
                own = far(p[a:z][:, None], zero[None, :]).sum(axis=0) + (len(terms) - (z - a)) * far(zero[g], zero)
                if least is None:
                    x, none = dense[t], zero[s]
                    own[filled] += np.add.reduceat(far(x, p) - far(x, none), ends[filled])
                pairs[g] = own
                worth = far(p[a:z], q[a:z])
                over = np.flatnonzero(p[a:z] > q[a:z])
                best = over[np.lexsort((t[a:z][over], -worth[over]))][:top]
                rows.append(np.full(len(best), g))
                values.append(worth[best])
                items.append(t[a:z][best])
        g, h = np.nonzero(~np.eye(many, dtype=bool))
        which, item = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, items))
        found = pa.concat_arrays([sources.take(pa.array(h)), terms.take(pa.array(item)) if len(item) else pa.array([], pa.string())])
        value = np.concatenate([pairs[g, h], *values])
        at = pa.array(np.concatenate([g, which]).astype(np.int64))
        part = pa.array(["pair"] * len(g) + ["term"] * len(which), pa.string())
        return pa.table([pa.array([lang] * len(value), pa.string()), sources.take(at), part, found, pa.array(value.astype(np.int64))], names=["lang", "source", "part", "item", "value"])

    return run


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chunk: int = CHUNK, entries: int = ENTRIES) -> DataFrame:
    """lang, source, part, item, value, rank: divergences of sources from each other (pair) and from their language (term).

    A term is a run of ASCII letters and non-ASCII characters, A-Z lower-cased; kept are those in at least
    least_docs documents of a language.  A source's share of a kept term is 1 + floor(1e9 * (count + 1) / (N + V)),
    N all its kept terms, V how many are kept; p from q it diverges by floor((p - q) ** 2 / q).  ``pair`` sums this over
    all kept terms for each other source of the language; ``term`` is from the language itself, for terms that the source has and
    whose share is over the language's, of which the first ``top`` are returned.  Ranks go by falling value, then item.

    Null texts, languages and sources count as empty ones; repeated rows as documents each; a source without terms has shares
    too, and a language without kept terms has values of 0.  An empty table gives no rows; other columns are ignored.
    A text over ``chunk`` bytes is counted in pieces cut between terms.  Totals must be under 9e15.

    A language's kept terms are dealt to blocks of about ``entries`` counts, so a common language is spread over tasks.  Each pair of
    sources of a language is a row of the result, so the sources of a language are the size of a task and its output.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = plain.mapInArrow(_counts(chunk), "lang string, source string, term string, n long, docs long")
    summed = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    within = "OVER (PARTITION BY lang, term)"
    known = summed.withColumn("of_lang", F.expr(f"sum(docs) {within}")).withColumn("first", F.expr(f"source = min(source) {within}"))
    # rows without a term name the sources that there are
    kept = save(known.where(F.col("term").isNull() | (F.col("of_lang") >= least_docs)).select("lang", "source", "term", "n", "first"), "terms")
    sums = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.when(F.col("term").isNotNull() & F.col("first"), 1).otherwise(0)).alias("kept"), F.greatest(F.lit(1), F.ceil(F.count("term") / entries)).alias("blocks"), F.count("*").alias("weight"))
    langs = save(sums, "langs")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = lookup(totals, langs, "lang", "weight").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = lookup(kept.where("term IS NOT NULL").select("lang", "source", "term", "n"), langs.select("lang", "blocks", "weight"), "lang", "weight").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    groups, placed = groups.toDF(*groups.columns), placed.toDF(*placed.columns)  # columns of their own, as both come from one table
    found = placed.groupBy("lang", "block").cogroup(groups.groupBy("lang", "block")).applyInArrow(_diverge(top), "lang string, source string, part string, item string, value long")
    parts = save(found, "divergences")
    discard(kept, langs)
    # a term is in one block, a pair in all
    whole = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = whole.withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)"))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
