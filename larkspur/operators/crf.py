"""A linear-chain conditional random field over sequences of attribute lists.

A sequence is a row: the attributes of each position and, to learn from, a class for each.  Attributes are hashed
to ``WIDTH`` columns, so the weights are a vector of bounded size: a weight for each column and class, for each pair of
neighbouring classes, and for the class that begins or ends a sequence.  The likelihood and its gradient are one
pass over the sequences: tasks run forward and backward sums over many sequences at once, Spark adds what they found
by column, and the driver, which holds vectors of that bounded size only, takes an L-BFGS step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import durable, scratch
from ..functions.text import once

WIDTH = 1 << 16  # columns that attributes are hashed to
CLASSES = 64  # classes that a model may have
BATCH = 2_000_000  # attributes that are scored at a time
MEMORY = 7  # steps that L-BFGS remembers


@dataclass
class Model:
    classes: list[str]
    columns: np.ndarray  # (WIDTH, classes)
    steps: np.ndarray  # (classes, classes)
    first: np.ndarray
    last: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([self.columns.ravel(), self.steps.ravel(), self.first, self.last])

    @classmethod
    def of(cls, classes: list[str], flat: np.ndarray, width: int) -> Model:
        k = len(classes)
        a, b = width * k, width * k + k * k
        return cls(classes, flat[:a].reshape(width, k), flat[a:b].reshape(k, k), flat[b : b + k], flat[b + k :])


class Chains:
    """Sequences of a batch: the scores of their positions, walked one position of all sequences at a time."""

    def __init__(self, model: Model, sizes: np.ndarray, counts: np.ndarray, columns: np.ndarray):
        """sizes: positions of each sequence; counts: attributes of each position; columns: theirs, one after the other."""
        self.model, self.counts, self.columns = model, counts, columns
        self.begin = np.cumsum(sizes) - sizes
        self.sizes = sizes
        self.order = np.argsort(-sizes, kind="stable")
        self.order = self.order[sizes[self.order] > 0]
        k = len(model.classes)
        self.score = np.zeros((len(counts), k))
        some = np.flatnonzero(counts)
        if len(some):
            first = (np.cumsum(counts) - counts)[some]
            for c, weights in enumerate(np.ascontiguousarray(model.columns.T)):  # a class's weights stay in the cache
                self.score[some, c] = np.add.reduceat(weights[columns], first)
        # positions by their place in a sequence, longer sequences first: those that have a next one come first
        place = np.arange(len(counts)) - np.repeat(self.begin, sizes)
        rank = np.empty(len(sizes), np.int64)
        rank[np.argsort(-sizes, kind="stable")] = np.arange(len(sizes))
        self.turn = np.lexsort((np.repeat(rank, sizes), place))
        self.width = np.bincount(place, minlength=1)
        self.start = np.cumsum(self.width) - self.width

    def _at(self, t: int) -> np.ndarray:
        """Places of position t in the sequences that have one."""
        n = int(np.searchsorted(-self.sizes[self.order], -t, side="left"))
        return self.begin[self.order[:n]] + t

    def _longest(self) -> int:
        return int(self.sizes.max(initial=0))

    def _ends(self) -> np.ndarray:
        return (self.begin + self.sizes - 1)[self.order]

    def forward(self) -> np.ndarray:
        """Log sums of all class sequences.  Keeps, for each position, the shares of its classes among beginnings."""
        top = self.score.max(axis=1, initial=0) if len(self.score) else np.zeros(0)
        self.own = np.exp(self.score - top[:, None])
        high = float(self.model.steps.max(initial=0))
        self.pass_on = np.exp(self.model.steps - high)
        own, a, scale = self.own[self.turn], np.zeros_like(self.score), np.ones(len(self.score))
        for t in range(self._longest()):
            lo, n = self.start[t], self.width[t]
            x = own[lo : lo + n] * (np.exp(self.model.first) if not t else a[self.start[t - 1] : self.start[t - 1] + n] @ self.pass_on)
            scale[lo : lo + n] = np.maximum(x.sum(1), 1e-300)
            a[lo : lo + n] = x / scale[lo : lo + n, None]
        self.a, self.scale = np.empty_like(a), np.empty_like(scale)
        self.a[self.turn], self.scale[self.turn] = a, scale
        each = np.log(self.scale) + top + high
        total = np.bincount(np.repeat(np.arange(len(self.sizes)), self.sizes), each, len(self.sizes)).astype(float)
        total[self.order] += np.log(self._over()) - high
        return total

    def _over(self) -> np.ndarray:
        return self.a[self._ends()] @ np.exp(self.model.last)

    def backward(self) -> np.ndarray:
        """What the rest of a sequence makes of the shares that ``forward`` kept: their product is a marginal probability."""
        b = np.zeros_like(self.score)
        b[self._ends()] = np.exp(self.model.last) / self._over()[:, None]
        rest, own = b[self.turn], (self.own / self.scale[:, None])[self.turn]
        for t in range(self._longest() - 1, 0, -1):
            lo, n = self.start[t], self.width[t]
            rest[self.start[t - 1] : self.start[t - 1] + n] += (rest[lo : lo + n] * own[lo : lo + n]) @ self.pass_on.T
        b[self.turn] = rest
        return b

    def marginals(self) -> np.ndarray:
        """Probability of each class at each position."""
        self.forward()
        return self.a * self.backward()

    def gradient(self, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood of the classes y, and its slopes by column, step, first and last class."""
        model, k = self.model, len(self.model.classes)
        total = self.forward()
        b = self.backward()
        over = -self.a * b
        first, last = self.begin[self.order], self._ends()
        inner = np.ones(len(y), bool)
        inner[first] = False
        inner = np.flatnonzero(inner)
        steps = -self.pass_on * (self.a[inner - 1].T @ (self.own[inner] * b[inner] / self.scale[inner][:, None]))
        steps += np.bincount(y[inner - 1] * k + y[inner], minlength=k * k).reshape(k, k)
        gold = self.score[np.arange(len(y)), y].sum() + model.steps[y[inner - 1], y[inner]].sum() + model.first[y[first]].sum() + model.last[y[last]].sum()
        over[np.arange(len(y)), y] += 1
        columns = np.stack([np.bincount(self.columns, np.repeat(over[:, c], self.counts), len(model.columns)) for c in range(k)], 1)
        return float(gold - total.sum()), columns, steps, over[first].sum(0), over[last].sum(0)

    def best(self) -> np.ndarray:
        """The most likely classes; ties go to the class of the smaller number."""
        k = len(self.model.classes)
        value, back = np.zeros_like(self.score), np.zeros(self.score.shape, np.int32)
        for t in range(self._longest()):
            at = self._at(t)
            if not t:
                value[at] = self.score[at] + self.model.first
            else:
                step = value[at - 1][:, :, None] + self.model.steps
                back[at] = step.argmax(1)
                value[at] = self.score[at] + step.max(1)
        out = np.zeros(len(value), np.int64)
        ends = (self.begin + self.sizes - 1)[self.order]
        out[ends] = (value[ends] + self.model.last).argmax(1) if k else 0
        for t in range(self._longest() - 1, 0, -1):
            at = self._at(t)
            out[at - 1] = back[at, out[at]]
        return out


def _lists(col) -> tuple[np.ndarray, pa.Array]:
    return np.diff(col.offsets.to_numpy()).astype(np.int64), col.flatten()


_BYTES = [("counts", "<u2"), ("columns", "<u4"), ("y", "u1")]


def _pressed(it):
    """Sequences as bytes: n positions, the attributes of each, their columns and the classes, which later passes read as they are."""
    for batch in it:
        sizes, inner = _lists(batch.column("x"))
        counts, columns = _lists(inner)
        at, upto = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(counts)])
        parts = [(counts, at), (columns.to_numpy(), upto[at]), (batch.column("y").flatten().to_numpy(), at)]
        made = [pa.array([x[a:z].astype(t).tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for (x, cut), (_, t) in zip(parts, _BYTES, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(sizes), *made], names=["n", *(name for name, _ in _BYTES)])


def _chains(batch, model: Model):
    """The batch's sequences, some at a time, with their place in it and classes."""
    if "x" in batch.schema.names:
        sizes, inner = _lists(batch.column("x"))
        counts, columns = _lists(inner)
        columns, y = columns.to_numpy(), None
    else:
        sizes = batch.column("n").to_numpy()
        counts, columns, y = (np.frombuffer(b"".join(batch.column(name).to_pylist()), t).astype(np.int64) for name, t in _BYTES)
    ends = np.cumsum(sizes)
    upto = np.concatenate([[0], np.cumsum(counts)])
    lo = 0
    while lo < len(sizes):
        a = int(ends[lo] - sizes[lo])
        hi = max(lo + 1, int(np.searchsorted(upto[ends], upto[a] + BATCH, side="right")))
        z = int(ends[hi - 1])
        yield lo, hi, Chains(model, sizes[lo:hi], counts[a:z], columns[upto[a] : upto[z]]), y[a:z] if y is not None else None
        lo = hi


def _gradient(sent, classes: list[str], width: int):
    def run(it):
        model = Model.of(classes, sent.value, width)
        k = len(classes)
        value, columns, rest = 0.0, np.zeros((width, k)), np.zeros((k + 2, k))
        for batch in it:
            for _, _, chains, y in _chains(batch, model):
                v, c, s, a, z = chains.gradient(y)
                value += v
                columns += c
                rest += np.concatenate([s, a[None], z[None]])
        some = np.flatnonzero(np.abs(columns).sum(1))
        g = np.concatenate([columns[some], rest, np.eye(1, k) * value])
        at = np.concatenate([some, width + np.arange(k + 2), [-1]])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.FixedSizeListArray.from_arrays(pa.array(g.ravel()), k).cast(pa.list_(pa.float64()))], names=["f", "g"])

    return run


def packed(rows: DataFrame, width: int = WIDTH, classes: list[str] | None = None) -> DataFrame:
    """identifier, x: columns of the attributes of each position, and with classes y, their numbers.

    rows: (identifier, features: array<array<string>>, and y: array<string>).  What is longer of features and y is cut.
    """
    hashed = lambda f: F.transform(f, lambda a: F.pmod(F.xxhash64(a), F.lit(width)).cast("int"))
    if classes is None:
        return rows.select("identifier", F.transform("features", hashed).alias("x"))
    n = F.least(F.size("features"), F.size("y"))
    number = F.array(*[F.lit(c) for c in classes])
    return rows.where(n > 0).select("identifier", F.transform(F.slice("features", F.lit(1), n), hashed).alias("x"), F.transform(F.slice("y", F.lit(1), n), lambda c: (F.array_position(number, c) - 1).cast("int")).alias("y"))


def minimise(f, x: np.ndarray, iterations: int, tolerance: float) -> np.ndarray:
    """L-BFGS; f gives (value, slope)."""
    value, slope = f(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        way, used = slope.copy(), []
        for s, g in reversed(moves):
            used.append((s @ way) / (s @ g))
            way -= used[-1] * g
        if moves:
            s, g = moves[-1]
            way *= (s @ g) / (g @ g)
        else:
            way /= max(1.0, float(np.abs(way).sum()))
        for (s, g), u in zip(moves, reversed(used), strict=True):
            way += s * (u - (g @ way) / (s @ g))
        fall = float(way @ slope)
        if fall <= 0:
            break
        size = 1.0
        for _ in range(20):
            new = x - size * way
            found, turned = f(new)
            if found <= value - 1e-4 * size * fall:
                break
            size /= 2
        else:
            break
        s, g = new - x, turned - slope
        if s @ g > 1e-12:
            moves = [*moves, (s, g)][-MEMORY:]
        better = value - found
        x, value, slope = new, found, turned
        if better <= tolerance * max(1.0, abs(value)):
            break
    return x


def train(rows: DataFrame, l2: float = 1.0, iterations: int = 25, tolerance: float = 1e-4, width: int = WIDTH) -> Model:
    """The model of greatest likelihood of the classes, less l2 / 2 times the squared weights.

    rows: (identifier, features: array<array<string>>, y: array<string>); classes are numbered by name, null ones count as
    empty.  Sequences without positions teach nothing.  Without any the model knows one class, the empty one.
    """
    rows = rows.withColumn("y", F.transform("y", lambda c: F.coalesce(c, F.lit(""))))
    classes = sorted(r[0] for r in rows.select(F.explode(F.array_distinct("y"))).distinct().limit(CLASSES + 1).collect())
    if len(classes) > CLASSES:
        raise ValueError(f"over {CLASSES} classes")
    if len(classes) < 2:
        return Model.of(classes or [""], np.zeros(width + 3), width)
    k, spark = len(classes), rows.sparkSession
    with scratch() as keep:
        pressed = packed(rows, width, classes).mapInArrow(_pressed, "n long, counts binary, columns binary, y binary")
        # a pass is as wide as the cluster, and walks sequences of like length together
        known = keep(durable(pressed.repartition(spark.sparkContext.defaultParallelism).sortWithinPartitions("n", "y", "columns")))

        def slope(x: np.ndarray) -> tuple[float, np.ndarray]:
            sent = spark.sparkContext.broadcast(x)
            made = known.mapInArrow(_gradient(sent, classes, width), "f long, g array<double>")
            got = made.groupBy("f").agg(*[F.sum(F.get("g", F.lit(c))).alias(f"g{c}") for c in range(k)]).toArrow()  # rows of bounded number
            sent.destroy()
            f, g = got.column("f").to_numpy(), np.stack([got.column(f"g{c}").to_numpy() for c in range(k)], 1)
            out = np.zeros((width + k + 2, k))
            out[f[f >= 0]] = g[f >= 0]
            return l2 / 2 * float(x @ x) - float(g[f < 0].sum()), l2 * x - out.ravel()

        return Model.of(classes, minimise(slope, np.zeros(width * k + k * k + 2 * k), iterations, tolerance), width)


def tag(rows: DataFrame, model: Model) -> DataFrame:
    """identifier, y: the most likely classes, and p: the marginal probability of each; one for each position."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    width = len(model.columns)

    def run(it):
        known = sent.value
        names = pa.array(known.classes, pa.string())
        for batch in it:
            y, p, sizes = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
            for _, _, chains, _ in _chains(batch, known):
                best = chains.best()
                y.append(best)
                p.append(chains.marginals()[np.arange(len(best)), best])
                sizes.append(chains.sizes)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
            found = names.take(pa.array(np.concatenate(y)))
            yield pa.RecordBatch.from_arrays([batch.column("identifier"), pa.ListArray.from_arrays(ends, found), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(p)))], names=["identifier", "y", "p"])

    return packed(rows, width).mapInArrow(run, f"identifier {rows.schema['identifier'].dataType.simpleString()}, y array<string>, p array<double>")


def text_features(words: Column, tags: Column | None = None) -> Column:
    """Attributes of each word: itself and its neighbours to two places, pairs with a neighbour, its lower case, its tag and its neighbours' tags.

    Words and tags are made once for a text, not for each of its words.
    """
    if tags is None:
        return once(words, lambda w: _attributes(w))
    return once(F.struct(words.alias("w"), tags.alias("t")), lambda x: _attributes(x["w"], x["t"]))


def _attributes(words: Column, tags: Column | None = None) -> Column:
    def of(w: Column, i: Column) -> Column:
        near = {k: F.get(words, i + k) for k in (-2, -1, 1, 2)}
        out = [F.concat(F.lit("w="), w), F.concat(F.lit("low="), F.lower(w)), F.lit("any")]
        out += [F.concat(F.lit(f"w[{k}]="), x) for k, x in near.items()]
        out += [F.concat(F.lit("w[-1]w="), near[-1], F.lit("|"), w), F.concat(F.lit("ww[1]="), w, F.lit("|"), near[1])]
        out += [F.when(i == 0, F.lit("first")), F.when(i == F.size(words) - 1, F.lit("last"))]
        if tags is not None:
            out += [F.concat(F.lit(f"t[{k}]="), F.get(tags, i + k)) for k in (-1, 0, 1)]
            out.append(F.concat(F.lit("tt="), F.get(tags, i - 1), F.lit("|"), F.get(tags, i)))
        return F.array_compact(F.array(*out))

    return F.transform(words, of)


def save_model(spark, model: Model, path: str) -> None:
    """The model as a Parquet table; its rows are the columns that have weights, steps, ends, and the classes' names."""
    width, k = model.columns.shape
    rest = np.concatenate([model.steps, model.first[None], model.last[None]])
    some = np.flatnonzero(np.abs(model.columns).sum(1))
    rows = [(int(f), g.tolist(), None) for f, g in zip(np.concatenate([some, width + np.arange(k + 2)]), np.concatenate([model.columns[some], rest]), strict=True)]
    rows.append((-1, [float(width)], model.classes))
    spark.createDataFrame(rows, "f long, g array<double>, classes array<string>").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark, path: str) -> Model:
    rows = spark.read.parquet(path).collect()  # rows of bounded number
    head = next(r for r in rows if r["f"] < 0)
    width, k = int(head["g"][0]), len(head["classes"])
    flat = np.zeros((width + k + 2, k))
    for r in rows:
        if r["f"] >= 0:
            flat[r["f"]] = r["g"]
    return Model.of(list(head["classes"]), flat.ravel(), width)
