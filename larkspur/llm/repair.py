"""Repair of conversation structure by a min-plus scan of matrices.

A repaired conversation's roles read ``(s?(ua)+)?``: nothing, or an optional system turn and then
user and assistant by turns.  That takes an automaton of four states (start, after system, after user,
after assistant).  Each turn is a 4x4 matrix: from a state to a state, the cheapest (cost, audit) of
what may be done with the turn, after any inserted turns.  Elements are multiplied by adding
costs and joining audits, and added by taking the lesser (cost, audit).  Audits of equal cost over the same
turns are no beginnings of one another (an insert costs something), so taking the lesser one first
changes nothing later, and the product is associative: turns can be multiplied in any grouping.

Turns are sorted over range partitions.  A conversation that lies within a partition is multiplied there
as a tree and repaired at once; one that reaches over a partition's border, or is longer than ``WHOLE``
turns or ``WHOLE_CHARS`` characters, is cut into pieces of ``PIECE`` turns, whose products are multiplied in a tree of groups of
``ARITY``, so no task ever holds a long conversation's turns.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL, discard, save

START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1  # what edits cost, and what a turn that stays truncated costs
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
WHOLE = 20_000  # turns of a conversation that a task repairs by itself
WHOLE_CHARS = 32_000_000
PIECE = 1_000  # turns of a piece
ARITY = 16  # products that are multiplied at a time
LEGAL = ("su", "ua", "au")
SPACES = " \t\n\x0b\f\r"

Matrix = dict[tuple[int, int], tuple[int, str]]


def add(into: Matrix, at: tuple[int, int], value: tuple[int, str]) -> None:
    if at not in into or value < into[at]:
        into[at] = value


def times(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = {}
    for (i, k), (cost, audit) in a.items():
        for j in range(4):
            if (k, j) in b:
                add(out, (i, j), (cost + b[k, j][0], audit + b[k, j][1]))
    return out


def closure() -> Matrix:
    """Any number of inserted turns: from a state to itself by none, on by the fewest."""
    out: Matrix = {(i, i): (0, "") for i in range(4)}
    for _ in range(4):
        for (i, k), (cost, audit) in list(out.items()):
            for role in "ua":
                if (k, role) in NEXT:
                    add(out, (i, NEXT[k, role]), (cost + INSERT, audit + "I"))
    return out


INSERTS = closure()


@lru_cache(maxsize=None)
def _turn(initial: str, fault: int) -> tuple:
    own: Matrix = {}
    for i in range(4):
        add(own, (i, i), (DELETE, "D"))
        if fault in (FINE, TRUNCATED):
            more = CUT_OFF if fault == TRUNCATED else 0
            if (i, initial) in NEXT:
                add(own, (i, NEXT[i, initial]), (more, "K"))
            for role in "ua":
                if (i, role) in NEXT:
                    add(own, (i, NEXT[i, role]), (REROLE + more, "R"))
    return tuple(times(INSERTS, own).items())


def turn_matrix(initial: str, fault: int) -> Matrix:
    """What may be done with a turn, after any inserted turns."""
    return dict(_turn(initial if initial in ("s", "u", "a") else "", fault))


def tree(matrices: list[Matrix]) -> Matrix:
    """Their product, neighbours first, so that audits are copied log2 times."""
    while len(matrices) > 1:
        matrices = [times(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0] if matrices else {(i, i): (0, "") for i in range(4)}


def power(m: Matrix, n: int) -> Matrix:
    out = tree([])
    while n:
        out, m, n = (times(out, m) if n & 1 else out), (times(m, m) if n > 1 else m), n >> 1
    return out


def best(m: Matrix) -> tuple[int, str]:
    """The cheapest (cost, audit) from the start to a state in which a conversation may end."""
    m = times(m, INSERTS)
    return min(m[START, end] for end in (START, ASSISTANT) if (START, end) in m)


def apply(audit: str, turns, state: int = START) -> tuple[list[dict], int]:
    """The repaired turns, and the state after them.  turns: role and text of each turn in order."""
    out, turns = [], iter(turns)
    for edit in audit:
        if edit == "I":
            role, text = ("a" if state == USER else "u"), ""
        else:
            own, text = next(turns)
            if edit == "D":
                continue
            role = own[:1] if edit == "K" else "a" if state == USER else "u"
        state = NEXT[state, role]
        out.append({"role": own if edit == "K" else NAMES[state], "text": text, "edit": edit})
    return out, state


def _merge(parts: list[dict]) -> dict:
    """Counts and product of neighbouring pieces of a conversation, in order."""
    out = {k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal", "distinct")}
    for a, b in zip(parts, parts[1:], strict=False):
        out["illegal"] += a["last"] + b["first"] not in LEGAL
        out["distinct"] -= a["most"] is not None and a["most"] == b["least"]
    known = [p for p in parts if p["most"] is not None]
    return out | {"first": parts[0]["first"], "last": parts[-1]["last"], "least": known[0]["least"] if known else None, "most": known[-1]["most"] if known else None, "product": tree([p["product"] for p in parts])}


def _one(turn: int | None, role: str, fault: int, copies: int) -> dict:
    """A turn and its copies, which are blank or duplicates of it."""
    again = BLANK if fault == BLANK else DUPLICATE
    m = turn_matrix(role[:1], fault)
    return {
        "blank": copies if fault == BLANK else 0,
        "duplicate": copies - (fault != DUPLICATE) if fault != BLANK else 0,
        "truncated": int(fault == TRUNCATED),
        "illegal": (copies - 1) * (role[:1] * 2 not in LEGAL),
        "distinct": int(turn is not None),
        "first": role[:1],
        "last": role[:1],
        "least": turn,
        "most": turn,
        "product": times(m, power(turn_matrix(role[:1], again), copies - 1)) if copies > 1 else m,
    }


def _report(s: dict) -> dict:
    cost, audit = best(s["product"])
    gaps = s["most"] - s["least"] + 1 - s["distinct"] if s["most"] is not None else 0
    return {"gaps": gaps, "blank": s["blank"], "duplicate": s["duplicate"], "truncated": s["truncated"], "illegal": s["illegal"], "cost": cost, "audit": audit}


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_COLUMNS = [c.split()[0] for c in _REPORT.split(", ")]
_TURNS = "turns array<struct<role:string,text:string,edit:string>>"
_RAW = "raw array<struct<at:long,turn:long,role:string,text:string,ends:boolean,blank:boolean,copies:long>>"


def _scan(schema: pa.Schema, whole: int, piece: int):
    """Conversations that lie within the sorted partition, repaired; the first and last one, and long ones, as raw turns."""

    def run(it):
        block = TaskContext.get().partitionId()
        held: list[dict] = []
        state = {"id": None, "any": False, "open": True, "at": 0, "chars": 0}
        out: list[dict] = []

        def raw():
            rows = [r for r in held if r["copies"]]
            rows = [{**r, "at": state["at"] + i} for i, r in enumerate(rows)]
            state["at"] += len(rows)
            out.append({"id": state["id"], "block": block, "raw": rows})
            held.clear()
            state["chars"] = 0

        def close(last: bool):
            if state["open"] or last:
                raw()
            else:
                seen: set[tuple[str, str]] = set()
                parts, turns = [], []
                for r in held:
                    if not r["copies"]:
                        continue
                    fault = BLANK if r["blank"] else DUPLICATE if (r["role"], r["text"]) in seen else FINE if r["ends"] else TRUNCATED
                    seen.add((r["role"], r["text"]))
                    parts.append(_one(r["turn"], r["role"], fault, r["copies"]))
                    turns += [(r["role"], r["text"])] * r["copies"]
                done = _report(_merge(parts)) if parts else _report({"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "distinct": 0, "most": None, "product": tree([])})
                out.append({"id": state["id"], "block": block, **done, "turns": apply(done["audit"], turns)[0]})
                held.clear()
                state["chars"] = 0

        def batch():
            got = pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
            return got

        for b in it:
            names = ["id", "turn", "role", "text", "ends", "blank", "copies"]
            for values in zip(*(b.column(n).to_pylist() for n in names), strict=True):
                r = dict(zip(names, values, strict=True))
                key = r.pop("id")
                if not state["any"] or key != state["id"]:
                    if state["any"]:
                        close(False)
                    # the first conversation may have begun in another partition
                    state |= {"id": key, "open": not state["any"], "any": True, "at": 0, "chars": 0}
                held.append(r)
                state["chars"] += len(r["text"])
                if len(held) >= whole or state["chars"] >= WHOLE_CHARS or state["open"] and len(held) >= piece:
                    state["open"] = True
                    raw()
                    yield batch()
                if len(out) >= 1000:
                    yield batch()
        if state["any"]:
            close(True)
            yield batch()

    return run


_MATRIX = pa.struct([pa.field("i", pa.int32()), pa.field("j", pa.int32()), pa.field("cost", pa.int64()), pa.field("audit", pa.string())])
_PART = "id {}, piece long, blank long, duplicate long, truncated long, illegal long, distinct long, first string, last string, least long, most long, product array<struct<i:int,j:int,cost:long,audit:string>>"
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "distinct", "first", "last", "least", "most")


def _as_row(key, piece: int, s: dict) -> dict:
    return {"id": key, "piece": piece, **{k: s[k] for k in _COUNTS}, "product": [{"i": i, "j": j, "cost": c, "audit": a} for (i, j), (c, a) in s["product"].items()]}


def _table(rows: list[dict], id_type: pa.DataType) -> pa.Table:
    fields = [("id", id_type), ("piece", pa.int64()), *((k, pa.string() if k in ("first", "last") else pa.int64()) for k in _COUNTS), ("product", pa.list_(_MATRIX))]
    return pa.Table.from_pylist(rows, schema=pa.schema(fields))


def _fold(table: pa.Table) -> pa.Table:
    """The product of a piece's turns."""
    rows = sorted(table.select(["nth", "turn", "initial", "fault", "copies"]).to_pylist(), key=lambda r: r["nth"])
    parts = [_one(r["turn"], r["initial"], r["fault"], r["copies"]) for r in rows]
    return _table([_as_row(table.column("id")[0].as_py(), table.column("piece")[0].as_py(), _merge(parts))], table.schema.field("id").type)


def _join(arity: int):
    """The product of neighbouring pieces."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["piece"])
        parts = [r | {"product": {(e["i"], e["j"]): (e["cost"], e["audit"]) for e in r["product"]}} for r in rows]
        return _table([_as_row(rows[0]["id"], rows[0]["piece"] // arity, _merge(parts))], table.schema.field("id").type)

    return run


def _finish(it):
    for b in it:
        rows = []
        for r in b.to_pylist():
            product = {(e["i"], e["j"]): (e["cost"], e["audit"]) for e in r["product"]}
            rows.append({"id": r["id"], **_report({**r, "product": product})})
        ints = [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("id", b.schema.field("id").type), *ints, ("audit", pa.string())]))


def _edits(it):
    """The audit of a conversation cut into the edits of its pieces, with the state before each."""
    for b in it:
        rows = []
        for r in b.to_pylist():
            audit, at, done = r["audit"], 0, 0
            system = (len(audit) - audit.count("D")) % 2  # turns but a first system turn come in pairs
            for k, n in enumerate(r["sizes"]):
                end = at
                while end < len(audit) and (n or k == len(r["sizes"]) - 1):
                    n -= audit[end] != "I"
                    end += 1
                state = START if not done else SYSTEM if system and done == 1 else ASSISTANT if (done - system) % 2 == 0 else USER
                rows.append({"id": r["id"], "piece": k, "edits": audit[at:end], "state": state})
                done += end - at - audit.count("D", at, end)
                at = end
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("id", b.schema.field("id").type), ("piece", pa.int64()), ("edits", pa.string()), ("state", pa.int32())]))


def _replay(types: pa.DataType):
    """The repaired turns of a piece."""

    def run(turns: pa.Table, edits: pa.Table) -> pa.Table:
        rows = sorted(turns.select(["nth", "role", "text", "copies"]).to_pylist(), key=lambda r: r["nth"])
        each = (t for r in rows for t in [(r["role"], r["text"])] * r["copies"])
        got, _ = apply(edits.column("edits")[0].as_py(), each, edits.column("state")[0].as_py())
        own = {"id": edits.column("id")[0].as_py(), "part": edits.column("piece")[0].as_py(), "turns": got}
        return pa.Table.from_pylist([own], schema=pa.schema([("id", edits.schema.field("id").type), ("part", pa.int64()), ("turns", types)]))

    return run


def damage(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) damaged by crc32(conv_id:turn) % 20, and copies, which says how often a row stands.

    0 drops a row (copies 0), 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 sets role user; nulls count as one
    space in the key and as texts and roles, while a null conv_id or turn stays null.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(blank("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def repair_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None, whole: int = WHOLE, piece: int = PIECE, arity: int = ARITY) -> DataFrame:
    """Reports and repaired turns: id, part, parts, gaps, blank, duplicate, truncated, illegal, cost, audit, turns.

    A conversation's turns are taken by turn (null first), then role and text.  It is one row, part 0 of 1, or if it is
    long several with a piece of its turns each; the report stands in part 0, and is null in others.  turns are
    (role, text, edit: K, R or I).
    ``copies_col`` says how often a row stands: 0 for a row that only names its conversation, which is then reported with zeros
    and no turns.  A null role or text counts as one space; a role other than s, u or a by its initial can't be kept.  A null id
    is a conversation like any other; an empty table gives no rows; other columns are ignored.

    Equal rows are counted first, so repeats are no hot group.  A conversation of any length is spread over tasks;
    its audit is one value, so it must fit into a row.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (text_col, role_col))
    copies = F.col(copies_col) if copies_col else F.lit(1)
    plain = rows.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))
    kept = plain.groupBy("id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    bare = F.rtrim("text", F.lit(SPACES))
    marked = kept.withColumn("blank", F.length(bare) == 0).withColumn("ends", F.substring(bare, -1, 1).isin(".", "!", "?"))
    id_type = rows.schema[id_col].dataType.simpleString()
    spread = marked.repartitionByRange("id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("id", "turn", "role", "text")
    schema = f"id {id_type}, block int, {_REPORT}, {_TURNS}, {_RAW}"
    scanned = save(spread.mapInArrow(_scan(_arrow(rows.sparkSession, schema), whole, piece), schema), "scan")
    done = scanned.where("raw IS NULL").select("id", F.lit(0).cast("long").alias("part"), F.lit(1).cast("long").alias("parts"), *_COLUMNS, "turns")
    return done.unionByName(_long(scanned.where("raw IS NOT NULL").select("id", "block", "raw"), id_type, piece, arity)).withColumnRenamed("id", id_col)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _with(rows: DataFrame, more: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """rows joined with more on keys, in which a null id equals a null id."""
    other = more.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in more.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(F.broadcast(other) if more.count() <= SMALL else other, on, how).drop(*[f"_{k}" for k in keys])


def _long(raw: DataFrame, id_type: str, piece: int, arity: int) -> DataFrame:
    """The conversations whose raw turns stand in several blocks or rows: as ``repair_conversations`` returns them."""
    turns = raw.select("id", "block", F.inline("raw"))
    offset = turns.groupBy("id", "block").count().select("id", "block", F.expr("sum(count) OVER (PARTITION BY id ORDER BY block) - count").alias("offset"))
    offsets = save(offset, "offsets")
    placed = _with(turns, offsets, ["id", "block"]).withColumn("nth", F.col("offset") + F.col("at")).withColumn("piece", F.floor(F.col("nth") / piece))
    firsts = save(placed.groupBy("id", "role", "text").agg(F.min("nth").alias("nth")).select("id", "nth", F.lit(True).alias("first")), "firsts")
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("ends"), FINE).otherwise(TRUNCATED)
    faults = _with(placed, firsts, ["id", "nth"]).select("id", "piece", "nth", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "copies")
    part = _PART.format(id_type)
    parts = save(faults.groupBy("id", "piece").applyInArrow(_fold, part), "products")
    while (parts.agg(F.max("piece")).first()[0] or 0) > 0:
        last, parts = parts, save(parts.groupBy("id", F.floor(F.col("piece") / arity).alias("above")).applyInArrow(_join(arity), part), "products")
        discard(last)
    ends = f"id {id_type}, {_REPORT}"
    sizes = placed.groupBy("id", "piece").agg(F.sum("copies").alias("n")).groupBy("id").agg(F.expr("transform(array_sort(collect_list(struct(piece, n))), x -> x.n)").alias("sizes"))
    found = _with(raw.select("id").distinct(), parts.mapInArrow(_finish, ends), ["id"])
    zeros = [F.coalesce(c, F.lit("" if c == "audit" else 0)).alias(c) for c in _COLUMNS]
    reports = save(_with(found.select("id", *zeros), sizes, ["id"]).withColumn("parts", F.greatest(F.lit(1), F.coalesce(F.size("sizes"), F.lit(1))).cast("long")), "reports")
    edits = reports.where("size(sizes) > 0").select("id", "audit", "sizes").mapInArrow(_edits, f"id {id_type}, piece long, edits string, state int")
    types = _arrow(raw.sparkSession, _TURNS).field("turns").type
    played = placed.groupBy("id", "piece").cogroup(edits.groupBy("id", "piece")).applyInArrow(_replay(types), f"id {id_type}, part long, {_TURNS}")
    none = reports.where("size(sizes) IS NULL OR size(sizes) <= 0").select("id", F.lit(0).cast("long").alias("part"), F.expr(f"CAST(array() AS {_TURNS.split(' ', 1)[1]})").alias("turns"))
    every = _with(played.unionByName(none), reports.select("id", "parts", *_COLUMNS), ["id"])
    out = save(every.select("id", "part", "parts", *[F.when(F.col("part") == 0, F.col(c)).alias(c) for c in _COLUMNS], "turns"), "repaired")
    discard(offsets, firsts, parts, reports)
    return out


def _digests(it):
    """The digest of each conversation whose parts follow one another."""
    key, digest, lines, any_row = None, None, 0, False
    for b in it:
        rows = []
        for r in b.to_pylist():
            if not any_row or r["id"] != key:
                if any_row:
                    rows.append({"id": key, "repaired_sha256": digest.hexdigest()})
                key, digest, lines, any_row = r["id"], hashlib.sha256(), 0, True
            for t in r["turns"]:
                digest.update((("\n" if lines else "") + t["role"] + ":" + t["text"]).encode("utf-8", "surrogatepass"))
                lines += 1
        schema = pa.schema([("id", b.schema.field("id").type), ("repaired_sha256", pa.string())])
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
    if any_row:
        yield pa.RecordBatch.from_pylist([{"id": key, "repaired_sha256": digest.hexdigest()}], schema=schema)


def digest_repaired(repaired: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Reports with repaired_sha256, of the repaired ``role:text`` of all turns joined by newlines.

    A digest is taken in order by its definition: the parts of a long conversation pass through one task one after the
    other, sorted, of which it holds one.
    """
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    short = repaired.where("parts = 1").withColumn("repaired_sha256", F.sha2(F.array_join(line, "\n"), 256))
    rest = repaired.where("parts > 1")
    streamed = rest.select(F.col(id_col).alias("id"), "part", "turns").repartition("id").sortWithinPartitions("id", "part")
    sums = streamed.mapInArrow(_digests, f"id {rest.schema[id_col].dataType.simpleString()}, repaired_sha256 string").withColumnRenamed("id", "_id")
    long = rest.where("part = 0").join(sums, F.col(id_col).eqNullSafe(F.col("_id")))
    columns = [id_col, *_COLUMNS, "repaired_sha256"]
    return short.select(*columns).unionByName(long.select(*columns))
