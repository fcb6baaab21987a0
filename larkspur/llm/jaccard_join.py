"""N-gram Jaccard join: blocked sparse matrix product of document by n-gram incidence.

Two texts link when the Jaccard similarity of their sets of distinct n-word
shingles is at least a threshold.  The join never ships the whole incidence
matrix.  It multiplies only the part that the size-derived bounds leave:

1. *Classes.*  Every text becomes a vertex, the hash of its shingle set; exact
   copies share one.  The same pass sends every column (shingle) of a task's vertices, as sorted
   32-bit numbers in slices of the hash range, to be counted exactly.
2. *Product over prefixes.*  Columns are ordered from rare to frequent: those that
   ``FREQUENT`` rows have go last, by their count (any total order is right; of too many to
   broadcast, only the more frequent count as such).  If x and y link, no size is less than t times
   the other, and they share a column among the first k(n) = n-ceil(t*n)+1 of each.
   Blocks of columns (hash ranges) go to tasks of a bounded size; each
   sorts its entries and adds up overlaps of pairs of rows.
3. *Bounds.*  Overlaps are summed over blocks by pair.  Linked rows overlap in
   ceil(t/(1+t)*(nx+ny)) columns at least.  Of the two prefixes one ends first; what is common up to
   its end has been counted, and beyond it that row has n-k(n) columns left.  So pairs are discarded whose
   count and the larger n-k(n) together don't reach the needed overlap.
4. *Clusters.*  What is left falls into candidate clusters (connected
   components).  A column in the prefixes of over ``HOT`` rows adds stars, not
   all its pairs: one for each run of row sizes without a gap of 1/t.  A column of over ``WIDE``
   rows in all isn't gathered at all: the rows that have it in a prefix are joined to a node that stands for
   it and their size band.
5. *Exact product.*  The whole rows of a cluster are multiplied exactly in blocks
   of about ``ROWS`` by ``ROWS``; a block keeps a spanning forest of its links and each row's number of
   links, never all pairs.

A cluster of m rows costs m*m/2 multiplications of rows in numpy blocks spread over
tasks; rows of no cluster are never multiplied or shipped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, common
from .common import components, discard, lookup, save
from .packing import _ranges
from .shingles import shingle_sets

SLICE = 4 << 20  # bytes of text to a slice of columns
SLICES = 4  # slices to a task
HELD = 1_000_000  # columns that a task holds before it hands them on
FREQUENT = 8  # rows from which a column is known as frequent
COLUMNS = 1 << 20  # frequent columns that are broadcast at most, 13 MB
HOT = 64  # rows of a column from which it adds stars
WIDE = 4096  # rows of a column from which it is a node
ROWS = 512  # rows of a block of the exact product
CELLS = 1 << 20  # columns of all rows of a block side, about
ENTRIES = 500_000  # entries of a block of columns
FLUSH = 400_000  # entries that a task holds before it hands them on


def _vertex(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(batch: pa.RecordBatch, n: int):
    """((id, key), set) of each row of a batch, of which about a megabyte of texts at a time are strings."""
    bpe.release()
    pa.default_memory_pool().release_unused()  # a worker that earlier stages used holds freed memory
    ids, keys, texts = batch.column("id"), batch.column("key"), batch.column("text")
    for lo, hi in _ranges(texts):
        yield from zip(zip(ids[lo:hi].to_pylist(), keys[lo:hi].to_pylist(), strict=True), shingle_sets(texts[lo:hi].to_pylist(), n), strict=True)


def _code(h: np.ndarray, slices: int) -> np.ndarray:
    """Slice and 32 further bits of a column, as one number; columns that share it count as one."""
    return ((h >> np.uint64(32)) * np.uint64(slices)) & np.uint64(0xFFFFFFFF00000000) | h & np.uint64(0xFFFFFFFF)


def _packed(step: np.ndarray) -> bytes:
    """Numbers byte by byte, low bytes first, so that high ones compress; bytes that all lack are left out."""
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    return bytes([width]) + step.view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u4").ravel()


_COUNTED = [("slice", pa.int32()), ("id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("v", pa.int64()), ("data", pa.binary())]


def _classes(n: int, slices: int):
    """A row (id, key, n, v) of each text, and the columns of the task's vertices slice by slice."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows, strict=True), _COUNTED, strict=True)], names=[name for name, _ in _COUNTED])

    def flush(held: list[np.ndarray]):
        code = np.sort(_code(np.concatenate(held), slices))
        at = (code >> np.uint64(32)).astype(np.int64)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
        step = np.diff(code, prepend=np.uint64(0))
        step[cut[:-1]] = code[cut[:-1]]
        step = step.astype("<u4")
        for lo in range(0, len(cut) - 1, 100):
            yield batch_of([(int(at[a]), None, None, None, None, _packed(step[a:z])) for a, z in zip(cut[lo : lo + 100], cut[lo + 1 : lo + 101], strict=False)])

    def run(it):
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0
        for batch in it:
            rows = []
            for (doc, key), s in _sets(batch, n):
                v = _vertex(s) if len(s) else None
                rows.append((doc % slices, doc, key, len(s), v, None))
                if len(s) and v not in seen:
                    seen.add(v)
                    held.append(s)
                    size += len(s)
                    if size > HELD:
                        yield from flush(held)
                        held, size = [], 0
            if rows:
                yield batch_of(rows)
        if size:
            yield from flush(held)

    return run


def _count(least: int):
    """The rows of texts as they are, and (v: code, n: count) of each column of least rows; rows come sorted by slice."""

    def counted(at: int, parts: list[bytes]):
        code = np.concatenate([np.cumsum(_unpacked(x), dtype=np.uint64) for x in parts])
        code, n = np.unique(code, return_counts=True)
        often = n >= least
        code = (code[often] | np.uint64(at << 32)).view(np.int64)
        return pa.RecordBatch.from_arrays([*[pa.nulls(len(code), pa.int64())] * 2, pa.array(n[often].astype(np.int64)), pa.array(code), pa.array(np.ones(len(code), bool))], names=["id", "key", "n", "v", "column"])

    def run(it):
        at, parts = None, []
        for batch in it:
            texts = batch.filter(pa.compute.is_null(batch.column("data")))
            if texts.num_rows:
                yield pa.RecordBatch.from_arrays([*(texts.column(c) for c in ("id", "key", "n", "v")), pa.array(np.zeros(texts.num_rows, bool))], names=["id", "key", "n", "v", "column"])
            batch = batch.filter(pa.compute.is_valid(batch.column("data")))
            for k, data in zip(batch.column("slice").to_pylist(), batch.column("data"), strict=True):
                if k != at and parts:
                    yield counted(at, parts)
                    parts = []
                at = k
                parts.append(data.as_py())
        if parts:
            yield counted(at, parts)

    return run


def _bound(num: int, den: int, n: np.ndarray) -> np.ndarray:
    """ceil(n * num / den) in integers."""
    return -(-(n * num) // den)


def _prefixes(n: int, t: tuple[int, int], frequent, slices: int, blocks: int):
    """Prefix columns of each vertex, as arrays of one block of columns to a row, and the
    joints (v, node) of vertices to wide columns under block -1."""

    def run(it):
        codes, counts = frequent.value
        bits = np.zeros(1 << 24, bool)  # tells most rare columns without a search
        bits[(codes & np.uint64(0xFFFFFF)).astype(np.int64)] = True
        p, q = t
        seen: set[int] = set()
        held: list[tuple] = []
        joints: list[tuple[int, int]] = []
        size = 0

        def flush():
            h = np.concatenate([x[0] for x in held])
            v = np.repeat(np.array([x[1] for x in held], np.int64), [len(x[0]) for x in held])
            m = np.repeat(np.array([x[2] for x in held], np.int32), [len(x[0]) for x in held])
            b = ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int32)
            o = np.argsort(b, kind="stable")
            cut = np.flatnonzero(np.diff(b[o])) + 1
            lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(o)]])
            # column by column, so that equal neighbours compress; 32 bits of the hash tell
            # columns of a block apart well enough, as candidates are compared exactly later
            cols = [h[o].astype("<u4"), v[o], m[o]]
            return pa.RecordBatch.from_arrays([pa.array(b[o][lo], pa.int32()), pa.array(b[o][lo].astype(np.int64)), pa.array([b"".join(c[a:z].tobytes() for c in cols) for a, z in zip(lo, hi, strict=True)], pa.binary())], names=["block", "spread", "data"])

        def joined():
            ends = np.array(joints, "<i8")
            return pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([joints[0][0]], pa.int64()), pa.array([ends.tobytes()], pa.binary())], names=["block", "spread", "data"])

        for batch in it:
            for _, s in _sets(batch, n):
                if not len(s) or (v := _vertex(s)) in seen:
                    continue
                seen.add(v)
                k = len(s) - int(_bound(p, q, np.int64(len(s)))) + 1
                code = _code(s, slices)
                may = np.flatnonzero(bits[(code & np.uint64(0xFFFFFF)).astype(np.int64)])
                at = np.minimum(np.searchsorted(codes, code[may]), len(codes) - 1) if len(codes) else may
                known = codes[at] == code[may] if len(codes) else np.zeros(0, bool)
                key = np.zeros(len(s), np.uint32)
                key[may[known]] = counts[at[known]]
                order = np.argsort(key, kind="stable")[:k] if known.any() else np.arange(k)  # s is sorted: ties go by hash
                if key[order[-1]] > WIDE:
                    wide = key[order] > WIDE
                    band = int(np.log(len(s)) / np.log(q / p) / 1.001)  # sizes of linked rows are in one band or in neighbours
                    for c in s[order[wide]].tolist():
                        joints += [(v, _node(c, band)), (v, _node(c, band + 1))]
                    if len(joints) > 10_000:
                        yield joined()
                        joints = []
                mine = s[order[key[order] <= WIDE]]
                # two columns of one row that 32 bits don't tell apart would count once: rows that share both are joined
                same = np.sort(_code(mine, blocks))
                for c in same[1:][same[1:] == same[:-1]].tolist():
                    joints.append((v, _node(c, -1)))
                held.append((mine, v, len(s)))
                size += len(mine)
                if size > FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
        if joints:
            yield joined()

    return run


def _node(column: int, band: int) -> int:
    """The node that stands for a wide column and a band of sizes."""
    return int.from_bytes(hashlib.blake2b(b"%d %d" % (column, band), digest_size=8).digest(), "little", signed=True)


_ENTRY = [("h", "<u4"), ("v", "<i8"), ("n", "<i4")]


def _entries(data: bytes) -> np.ndarray:
    n = len(data) // sum(np.dtype(k).itemsize for _, k in _ENTRY)
    out, at = np.empty(n, np.dtype(_ENTRY)), 0
    for name, kind in _ENTRY:
        out[name] = np.frombuffer(data, kind, n, at)
        at += n * np.dtype(kind).itemsize
    return out


PAIRS = ["x", "y", "nx", "ny", "c"]  # c is 0 in a star
_PAIR_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]


def _product(t: tuple[int, int]):
    """Overlaps of pairs of rows over one block of columns after another."""
    p, q = t

    def one(parts: list[bytes]):
        e = np.concatenate([_entries(x) for x in parts])
        e = e[np.lexsort((e["v"], e["h"]))]
        if len(e) > 1:  # the same entry of a vertex from several tasks
            e = e[np.concatenate([[True], (e["h"][1:] != e["h"][:-1]) | (e["v"][1:] != e["v"][:-1])])]
        first = np.concatenate([[True], e["h"][1:] != e["h"][:-1]])
        run = np.cumsum(first) - 1
        m = np.bincount(run)
        hot = m[run] > HOT
        found = []
        if hot.any():
            w = e[hot]
            r = run[hot]
            # rows of a column whose sizes have no gap of q/p between them; none beyond it can link
            o = np.lexsort((w["n"], r))
            far = q * w["n"][o][:-1].astype(np.int64) < p * w["n"][o][1:]
            part = np.empty(len(o), np.int64)
            part[o] = np.concatenate([[0], np.cumsum((np.diff(r[o]) != 0) | far)])
            r = part
            # the hub is the row that most hot columns of this block hold
            _, inv, deg = np.unique(w["v"], return_inverse=True, return_counts=True)
            o = np.lexsort((w["v"], -deg[inv], r))
            head = np.flatnonzero(np.concatenate([[True], np.diff(r[o]) != 0]))
            hub = np.repeat(w["v"][o][head], np.diff(np.concatenate([head, [len(o)]])))
            star = np.unique(np.stack([w["v"][o], hub], 1)[w["v"][o] != hub], axis=0)
            z = np.zeros(len(star), np.int32)
            found.append((star[:, 0], star[:, 1], z, z, z))
        cold = e[(m[run] > 1) & ~hot]
        out = []
        for lag in range(1, HOT):
            if len(cold) <= lag:
                break
            a, b = cold[:-lag], cold[lag:]
            same = np.flatnonzero(a["h"] == b["h"])
            if not len(same):
                break
            a, b = a[same], b[same]
            swap = (a["n"] > b["n"]) | ((a["n"] == b["n"]) & (a["v"] > b["v"]))
            x, y = np.where(swap, b, a), np.where(swap, a, b)
            nx, ny = x["n"].astype(np.int64), y["n"].astype(np.int64)
            keep = (x["v"] != y["v"]) & (q * nx >= p * ny)
            out.append((x[keep], y[keep]))
        if out:
            x, y = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
            o = np.lexsort((y["v"], x["v"]))
            x, y = x[o], y[o]
            if len(x):
                head = np.flatnonzero(np.concatenate([[True], (x["v"][1:] != x["v"][:-1]) | (y["v"][1:] != y["v"][:-1])]))
                c = np.diff(np.concatenate([head, [len(x)]])).astype(np.int32)
                found.append((x["v"][head], y["v"][head], x["n"][head], y["n"][head], c))
        for f in found:
            for lo in range(0, len(f[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 50_000], k) for c, k in zip(f, _PAIR_TYPES, strict=True)], names=PAIRS)

    def run(it):
        held, at = [], None
        for batch in it:
            for b, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                if b < 0:
                    ends = np.frombuffer(data.as_py(), "<i8").reshape(-1, 2)
                    z = pa.array(np.zeros(len(ends), np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1]), z, z, z], names=PAIRS)
                    continue
                if b != at and held:
                    yield from one(held)
                    held = []
                at = b
                held.append(data.as_py())
        if held:
            yield from one(held)

    return run


def _rows_of(n: int, bitmap):
    """(v, id, data) for the texts whose id the bitmap may hold: whole sorted sets, of which a task holds about ``HELD`` columns."""

    def made(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["v", "least", "data"])

    def run(it):
        bits = np.frombuffer(bitmap.value, np.uint8)
        size = np.uint64(len(bits) * 8 - 1)
        for batch in it:
            at = batch.column("id").to_numpy().view(np.uint64) & size
            batch = batch.filter(pa.array((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)))
            found, size = [], 0
            for (doc, _), s in _sets(batch, n):
                if len(s):
                    found.append((_vertex(s), doc, s.tobytes()))
                    size += len(s)
                if size > HELD:
                    yield made(found)
                    found, size = [], 0
            yield made(found)

    return run


def _bitmap(df: DataFrame, bits: int) -> bytes:
    """Bit id mod 2**bits is set for each id of df; the words are or-ed by Spark."""
    at = df.select(F.col("id").bitwiseAND(F.lit((1 << bits) - 1)).alias("at"))
    words = at.groupBy(F.shiftright("at", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(at & 31)))").alias("x"))
    out = np.zeros(1 << (bits - 5), np.uint32)
    got = words.toPandas()
    out[got["w"].to_numpy().astype(np.int64)] = got["x"].to_numpy().astype(np.uint32)
    return out.tobytes()


def _exact(t: tuple[int, int]):
    """Links of one block of rows by another: a spanning forest (a, b), and (a, links) of each
    row, the number of texts that it links to in this block."""
    p, q = t

    def run(key, table):
        b1, b2 = key[1].as_py(), key[2].as_py()
        v, first = np.unique(table.column("v").to_numpy(), return_index=True)
        table = table.take(pa.array(first))
        side, copies = table.column("b").to_numpy(), table.column("copies").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("data")]
        n = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), n)
        _, col, df = np.unique(flat, return_inverse=True, return_counts=True)
        keep = df[col] > 1
        row, col = row[keep], col[keep]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        m = len(v)
        over = np.zeros((m, m), np.int32)
        # columns in strips: a dense strip of rows by columns, multiplied by itself
        starts = np.flatnonzero(np.concatenate([[True], np.diff(col) != 0])) if len(col) else np.zeros(0, np.int64)
        number = np.cumsum(np.concatenate([[0], (np.diff(col) != 0).astype(np.int64)])) if len(col) else col
        step = 2048
        for lo in range(0, len(starts), step):
            a = starts[lo]
            z = starts[lo + step] if lo + step < len(starts) else len(row)
            strip = np.zeros((m, min(step, len(starts) - lo)), np.float32)
            strip[row[a:z], number[a:z] - lo] = 1
            over += np.rint(strip @ strip.T).astype(np.int32)
        union = n[:, None] + n[None, :] - over
        link = q * over.astype(np.int64) >= p * union
        np.fill_diagonal(link, False)
        if b1 != b2:
            link &= side[:, None] != side[None, :]
        links = link @ copies
        parent = list(range(m))

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        out = []
        for i in range(m):
            for j in np.flatnonzero(link[i, i + 1 :]).tolist():
                a, b = find(i), find(i + 1 + j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((i, i + 1 + j))
        x, y = np.array(out, np.int64).reshape(-1, 2).T
        some = np.flatnonzero(links)
        return pa.table({"a": pa.array(np.concatenate([v[x], v[some]])), "b": pa.array(np.concatenate([v[y], v[some]])), "links": pa.array(np.concatenate([np.zeros(len(x), np.int64), links[some]]))})

    return run


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: tuple[int, int] = (3, 4), key_col: str | None = None) -> DataFrame:
    """One row per document: its id, n_shingles, component_id and n_links.

    With key_col, a column of whole numbers that tells rows of one id apart, that column comes back too, and
    ``first``: whether a row has the least id, then key, of its component.

    component_id is the smallest id reachable over links of Jaccard similarity
    >= threshold (a fraction of two integers), the document itself included; n_links counts the
    other rows that the document links to, copies among them.
    Null and wordless texts have an empty set and link with nothing; repeated
    texts share a class, also those of one id, whose rows stay rows each; rows with a null id are
    dropped, as nothing can name them; an empty table gives no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    key = F.col(key_col).cast("long") if key_col else F.lit(0).cast("long")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), key.alias("key"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    p, q = threshold
    slices = max(16, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SLICE))
    dealt = docs.mapInArrow(_classes(n, slices), "slice int, id long, key long, n long, v long, data binary").repartition(max(1, int(slices) // SLICES), "slice").sortWithinPartitions("slice")
    both = save(dealt.mapInArrow(_count(FREQUENT), "id long, key long, n long, v long, column boolean"), "classes")
    rows, columns = both.where("NOT column").select("id", "key", "n", "v"), both.where("column").select("n", "v")
    total = rows.agg(F.sum("n")).first()[0] or 0
    ids = rows.where("v IS NOT NULL").groupBy("v").agg(F.min(F.struct("id", "key")).alias("m"), F.count("*").alias("copies"), F.first("n").alias("n")).select("v", "copies", "n", F.col("m.id").alias("least"), F.col("m.key").alias("key"))
    comp = None
    if total:
        frequent = spark.sparkContext.broadcast(_frequent(columns))
        blocks = max(16, -(-total // (4 * ENTRIES)))
        parts = docs.mapInArrow(_prefixes(n, threshold, frequent, slices, blocks), "block int, spread long, data binary")
        pairs = parts.repartition(int(blocks), "spread").sortWithinPartitions("block").mapInArrow(_product(threshold), "x long, y long, nx int, ny int, c int")
        pairs = pairs.groupBy("x", "y").agg(F.max("nx").cast("long").alias("nx"), F.max("ny").cast("long").alias("ny"), F.sum("c").alias("c"), F.min("c").alias("least"))
        may = F.expr(f"c + (ny * {p} + {q - 1}) div {q} - 1")  # y is no smaller, so it has more left
        edges = pairs.where((F.col("least") == 0) | ((p + q) * may >= p * (F.col("nx") + F.col("ny")))).select(F.col("x").alias("a"), F.col("y").alias("b"))
        found = components(edges, "candidates")
        # nodes of wide columns have no row
        clusters = save(found.select(F.col("node").alias("v"), F.col("root").alias("cluster")).join(ids, "v"), "clusters")
        discard(found)
        many = clusters.count()
        if many:
            bits = min(27, max(16, int(many * 32).bit_length()))
            bitmap = spark.sparkContext.broadcast(_bitmap(clusters.select(F.col("least").alias("id")), bits))
            sets = docs.mapInArrow(_rows_of(n, bitmap), "v long, least long, data binary")
            sizes = clusters.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / ROWS), F.ceil(F.sum("n") / CELLS)).alias("k"), F.count("*").alias("of"))
            sized = lookup(clusters.select("v", "least", "cluster", "copies"), sizes.where("of > 1"), "cluster", "of").where("k IS NOT NULL")
            sized = sized.withColumn("b", F.pmod(F.xxhash64("v"), F.col("k")))
            # the row of the least id stands for a vertex; rows that repeat it are left out by the product
            paired = sets.join(F.broadcast(sized) if many <= common.SMALL else sized, ["v", "least"]).select("cluster", "v", "copies", "b", "data", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("o"))
            paired = paired.withColumn("b1", F.least("b", "o")).withColumn("b2", F.greatest("b", "o"))
            links = save(paired.groupBy("cluster", "b1", "b2").applyInArrow(_exact(threshold), "a long, b long, links long"), "links")
            linked = components(links.where("a <> b"), "linked")
            degree = links.where("a = b").groupBy(F.col("a").alias("v")).agg(F.sum("links").alias("links"))
            comp = save(degree.join(linked, F.col("v") == F.col("node"), "left").select("v", "links", "root"), "members")
            discard(linked, links)
        discard(clusters)
    # the smallest id of each vertex, then of each component; others are their own component
    ids = ids.join(comp, "v", "left") if comp is not None else ids.withColumns({"links": F.lit(0).cast("long"), "root": F.lit(None).cast("long")})
    ids = save(ids.where("copies > 1 OR root IS NOT NULL").withColumn("root", F.coalesce("root", "v")), "members")
    least = ids.groupBy("root").agg(F.min(F.struct("least", "key")).alias("m"), F.count("*").alias("of")).select("root", "of", F.col("m.least").alias("component_id"), F.col("m.key").alias("first_key"))
    to = save(lookup(ids.drop("key"), least, "root", "of").select("v", "copies", "component_id", "first_key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "components")
    found = lookup(rows, to, "v", "copies")
    out = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links")]
    if key_col:
        first = F.col("component_id").isNull() | ((F.col("component_id") == F.col("id")) & F.col("first_key").eqNullSafe(F.col("key")))
        out += [F.col("key").alias(key_col), first.alias("first")]
    return found.select(*out)


def _frequent(columns: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes, sorted, and counts of the frequent columns: of all, or of those from the least power of two that leaves ``COLUMNS``."""
    steps = columns.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).count().orderBy(F.desc("e")).collect()
    least, held = 0, 0
    for r in steps:
        held += r["count"]
        if held > COLUMNS:
            least = 2 ** (r["e"] + 1)
            break
    got = columns.where(F.col("n") >= least).toPandas().sort_values("v")
    codes = got["v"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(codes, kind="stable")
    return codes[order], np.minimum(got["n"].to_numpy()[order], 2**32 - 1).astype(np.uint32)
