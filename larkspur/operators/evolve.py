"""Evolving word scores: a steady-state genetic search with distributed fitness.

A genome is one score for each enumerated word.  Sentences stay in Spark; a
generation's genomes are sent out together and every sentence is scored once for all of
them, so a generation is one pass over the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoint import durable, scratch
from .labels import number
from .phrases import fold


@dataclass
class Settings:
    population: int = 100
    generations: int = 20
    children: int = 8
    power: float = 3.5
    mutation_rate: float = 0.05
    mutation_size: float = 0.025
    decay_every: int = 500
    seed: int = 0


CELLS = 8_000_000  # scores that are broadcast at most, 32 MB


def enumerated(df: DataFrame, tokens: Column) -> tuple[DataFrame, DataFrame]:
    """(words: word, id from 0; sentences: identifier, ids, y) of df with a column y."""
    rows = durable(df.select("identifier", "y", tokens.alias("w")))
    words = durable(number(rows.select(F.explode("w").alias("word")).distinct(), "word", 0, "id").select("word", "id"))
    placed = rows.select("identifier", F.posexplode("w").alias("at", "word")).join(words, "word").groupBy("identifier").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("s"))
    out = rows.select("identifier", "y").join(placed, "identifier", "left")
    return words, durable(out.select("identifier", F.coalesce(F.col("s.id"), F.array().cast("array<bigint>")).cast("array<int>").alias("ids"), "y"))


def fitness(sentences: DataFrame, genomes: np.ndarray) -> np.ndarray:
    """Percent of sentences whose summed score has the sign of their label; an undecided one is wrong.

    sentences: (ids: array<int>, y: 1 or -1).  Genomes of up to ``CELLS`` scores go to every task; larger ones
    are a table of word ids that is joined to the words of the sentences.
    """
    if genomes.size > CELLS:
        return _joined_fitness(sentences, genomes)
    sent = sentences.sparkSession.sparkContext.broadcast(genomes.astype(np.float32))

    def run(it):
        g = sent.value
        right, n = np.zeros(len(g)), 0
        for batch in it:
            for ids, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                right += np.sign(g[:, ids].sum(1)) == y
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(g)), pa.int32()), pa.array(right), pa.array([float(n)] * len(g))], names=["g", "r", "n"])

    found = sentences.select("ids", "y").mapInArrow(run, "g int, r double, n double").groupBy("g").agg(F.sum("r").alias("r"), F.sum("n").alias("n")).toPandas().sort_values("g")
    return (100 * found["r"] / found["n"].clip(lower=1)).to_numpy()


def _joined_fitness(sentences: DataFrame, genomes: np.ndarray) -> np.ndarray:
    spark, k = sentences.sparkSession, len(genomes)
    import pandas as pd

    scores = None
    for a in range(0, genomes.shape[1], 100_000):
        part = spark.createDataFrame(pd.DataFrame({"id": np.arange(a, min(a + 100_000, genomes.shape[1])), "g": genomes[:, a : a + 100_000].T.tolist()}), "id int, g array<double>")
        scores = part if scores is None else scores.union(part)
    rows = sentences.select(F.xxhash64("ids", "y", F.monotonically_increasing_id()).alias("s"), "ids", "y")
    rows = durable(rows)
    sums = rows.select("s", F.explode("ids").alias("id")).join(durable(scores), "id").groupBy("s").agg(*(F.sum(F.col("g")[j]).alias(f"g{j}") for j in range(k)))
    both = rows.select("s", "y").join(sums, "s", "left")
    return np.array(both.agg(*(F.coalesce(100 * F.avg((F.signum(F.coalesce(f"g{j}", F.lit(0.0))) == F.col("y")).cast("double")), F.lit(0.0)) for j in range(k))).first(), float)


def verdict(score: Column) -> Column:
    """1, -1, or null where a score decides nothing."""
    return F.when(score > 0, 1).when(score < 0, -1)


def percent_correct(rows: DataFrame, label: str = "y", predicted: str = "prediction") -> DataFrame:
    """One row: total, correct, correct by label, decided, percent; a null prediction is undecided and wrong."""
    hit = F.coalesce(F.col(label) == F.col(predicted), F.lit(False))
    of = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    n = rows.agg(F.count("*").alias("total"), of(hit).alias("correct"), of(hit & (F.col(label) == 1)).alias("positive_correct"), of(hit & (F.col(label) == -1)).alias("negative_correct"), of(F.col(predicted).isNotNull()).alias("decided"))
    return n.withColumn("percent", F.when(F.col("total") > 0, 100.0 * F.col("correct") / F.col("total")).otherwise(0.0))


def signals(sentences: DataFrame, scores: DataFrame) -> DataFrame:
    """identifier, y, signal: the score of each word in order; scores: (id, score), words without one are 0."""
    rows = sentences.select("identifier", F.posexplode("ids").alias("at", "id")).join(scores, "id", "left")
    lists = rows.groupBy("identifier").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("score", F.lit(0.0)).alias("score")))).alias("s"))
    return sentences.select("identifier", "y").join(lists, "identifier", "left").select("identifier", "y", F.coalesce(F.col("s.score"), F.array().cast("array<double>")).alias("signal"))


def sign_change_column(signal: Column) -> Column:
    """How often a signal's sign changes, zeros left out.  Deviation: both signs count."""
    s = F.filter(F.transform(signal, lambda x: F.signum(x)), lambda x: x != 0)
    n = F.greatest(F.size(s) - 1, F.lit(0))
    return F.size(F.filter(F.zip_with(F.slice(s, F.lit(1), n), F.slice(s, F.lit(2), n), lambda a, b: a != b), lambda x: x))


SIDE, CELLS_SIDE = 1 << 16, 1 << 22  # signals of a block that neighbours are looked for in, and their values together
CLOSE = 2e-5  # more than single precision is off for signals of unit length


def _block(table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Signals as lines of a matrix, followed by zeros, and their lengths."""
    col = table.column(name).combine_chunks()
    flat, n = col.flatten().to_numpy(zero_copy_only=False), col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), max(1, int(n.max(initial=0)))))
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out, n


def _unit(rows: np.ndarray, n: int) -> np.ndarray:
    """Signals over n places with their means taken off, of length 1, or 0 if they are constant."""
    x = rows[:, :n]
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    square = (x * x).sum(1)
    x = x - x.mean(1)[:, None]
    size = np.sqrt((x * x).sum(1))
    return x * np.where(size > 1e-12 * np.sqrt(square) + 1e-150, 1 / np.where(size > 0, size, 1), 0.0)[:, None]


def _best(known: pa.Table, asked: pa.Table) -> pa.Table:
    """For each asked signal the known one that correlates best, of equals the least t.

    Places count up to the longer of two signals, so asked signals meet the known ones by that length.  Products of
    single precision find all that can be best; these few are compared in double precision.
    """
    known = known.sort_by("t")
    (b, nb), (a, na) = _block(known, "known"), _block(asked, "asked")
    best, place = np.full(len(na), -np.inf), np.zeros(len(na), np.int64)
    for n in np.unique(np.concatenate([na, nb])).tolist() if len(na) and len(nb) else []:
        for mine, theirs in ((na == n, nb <= n), (na < n, nb == n)):
            i, j = np.flatnonzero(mine), np.flatnonzero(theirs)
            if not len(i) or not len(j):
                continue
            left, right = _unit(a[i], max(1, n)), _unit(b[j], max(1, n))
            short, across = left.astype(np.float32), np.ascontiguousarray(right.astype(np.float32).T)
            step = max(1, (1 << 20) // len(j))
            for k in range(0, len(i), step):
                c = short[k : k + step] @ across
                r, at = np.nonzero(c >= (np.maximum(c.max(1), best[i[k : k + step]].astype(np.float32)) - np.float32(CLOSE))[:, None])
                if not len(r):
                    continue
                exact = np.concatenate([np.round(np.einsum("ij,ij->i", left[k + r[z : z + 65536]], right[at[z : z + 65536]]), 12) + 0.0 for z in range(0, len(r), 65536)])
                who, t = i[k + r], j[at]
                first = np.lexsort((t, -exact, who))
                first = first[np.flatnonzero(np.diff(who[first], prepend=-1))]
                who, t, exact = who[first], t[first], exact[first]
                more = (exact > best[who]) | ((exact == best[who]) & (t < place[who]))
                best[who[more]], place[who[more]] = exact[more], t[more]
    some = np.flatnonzero(best > -np.inf)
    at = pa.array(place[some])
    return pa.table({"identifier": asked.column("identifier").take(pa.array(some)), "t": known.column("t").take(at), "y": known.column("y").take(at), "c": pa.array(best[some])})


def nearest_signals(train: DataFrame, test: DataFrame, group: str | None = None) -> DataFrame:
    """identifier, prediction: the label of the training signal that correlates best, of equals the least identifier's.

    train and test: (identifier, y, signal).  With group (a column of both) only signals of one group are compared, as a meta
    classifier does; a row whose group has no training signal is undecided (null).  All signals of a group are compared, in blocks
    of about ``SIDE`` by ``SIDE`` (or ``CELLS_SIDE`` values), as many as the group needs, of which only the best leaves.
    """
    g = F.col(group).cast("long") if group else F.lit(0).cast("long")
    with scratch() as keep:
        known = keep(durable(train.select(g.alias("_g"), F.col("identifier").alias("t"), F.col("y").cast("int").alias("y"), F.col("signal").alias("known"))))
        asked = keep(durable(test.select(g.alias("_g"), "identifier", "y", F.col("signal").alias("asked"))))

        def parts(df: DataFrame, signal: str, name: str) -> DataFrame:
            n = F.greatest(F.ceil(F.count("*") / F.lit(SIDE)), F.ceil(F.sum(F.size(signal)) / F.lit(CELLS_SIDE)), F.lit(1).cast("long"))
            return df.groupBy("_g").agg(n.cast("int").alias(name))

        blocks = parts(known, "known", "_across").join(parts(asked, "asked", "_down"), "_g")
        dealt = lambda df, by, own, n, other, m: df.join(blocks, "_g").withColumns({own: F.pmod(F.xxhash64(by), F.col(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(m) - 1))})
        left = dealt(known, "t", "_j", "_across", "_i", "_down").select("_g", "_i", "_j", "t", "y", "known")
        right = dealt(asked, "identifier", "_i", "_down", "_j", "_across").select("_g", "_i", "_j", "identifier", "asked")
        found = left.groupBy("_g", "_i", "_j").cogroup(right.groupBy("_g", "_i", "_j")).applyInArrow(_best, "identifier long, t long, y int, c double")
        best = found.groupBy("identifier").agg(F.min_by("y", F.struct(-F.col("c"), F.col("t"))).alias("prediction"))
        return durable(asked.select("identifier", "y").join(best, "identifier", "left"))


def k_cross(rows: DataFrame, classify, folds: int = 5, seed: int = 0) -> DataFrame:
    """fold, percent: of each fold the percentage right of classify(training rows, test rows) -> (identifier, y, prediction)."""
    dealt = durable(rows.withColumn("_fold", fold(F.col("identifier"), folds, seed)))
    out = None
    for k in range(folds):
        made = percent_correct(classify(dealt.where(F.col("_fold") != k), dealt.where(F.col("_fold") == k))).select(F.lit(k).alias("fold"), "total", "correct", "percent")
        out = made if out is None else out.union(made)
    return out


def self_evaluation(rows: DataFrame, classify) -> DataFrame:
    """percent_correct of a classifier on the rows that it was trained on."""
    return percent_correct(classify(rows, rows))


def exported_genome(words: DataFrame, scores: DataFrame) -> DataFrame:
    """value: lines of word, number and score, tab-separated; words: (word, id), scores: (id, score)."""
    return words.join(scores, "id").select("id", F.concat_ws("\t", "word", F.col("id").cast("string"), F.col("score").cast("string")).alias("value"))


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """word, id, score of an exported genome."""
    p = F.split("value", "\t")
    return spark.read.text(path).select(p[0].alias("word"), p[1].cast("long").alias("id"), p[2].cast("double").alias("score"))


def evolve(sentences: DataFrame, words: int, settings: Settings = Settings(), score=fitness) -> tuple[np.ndarray, float]:
    """(best genome, its fitness): roulette on fitness**power, uniform crossover, small mutations;
    a child replaces the worst if it is better."""
    rng = np.random.default_rng(settings.seed)
    pool = rng.uniform(-1, 1, (settings.population, words))
    value = score(sentences, pool)
    size, made = settings.mutation_size, 0
    for _ in range(settings.generations):
        p = np.maximum(value, 1e-9) ** settings.power
        p /= p.sum()
        a, b = (pool[rng.choice(len(pool), settings.children, p=p)] for _ in range(2))
        young = np.where(rng.random(a.shape) < 0.5, a, b)
        young = young + (rng.random(young.shape) < settings.mutation_rate) * rng.uniform(-size, size, young.shape)
        for child, v in zip(young, score(sentences, young), strict=True):
            worst = int(value.argmin())
            if v > value[worst]:
                pool[worst], value[worst] = child, v
            made += 1
            if made % settings.decay_every == 0:
                size *= 0.9
    best = int(value.argmax())
    return pool[best], float(value[best])


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Pearson correlation of two score signals, the shorter followed by zeros (deviation: means are taken off)."""
    n = max(len(a), len(b))
    if not n:
        return 0.0
    a, b = np.pad(a, (0, n - len(a))), np.pad(b, (0, n - len(b)))
    a, b = a - a.mean(), b - b.mean()
    d = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / d) if d else 0.0


def nearest_signal(signals: list[np.ndarray], labels: list[int], asked: np.ndarray) -> int:
    """The label of the signal that correlates best, the first on a tie."""
    return labels[int(np.argmax([correlation(s, asked) for s in signals]))] if signals else 0


def sign_changes(signal: np.ndarray) -> int:
    s = np.sign(signal)
    s = s[s != 0]
    return int((s[1:] != s[:-1]).sum())


def length_group(n: int, divisor: int) -> int:
    return n // divisor


def genome_rows(names: list[str], genome: np.ndarray) -> list[str]:
    """Lines of an exported genome: word, number, score."""
    return [f"{w}\t{i}\t{float(x)!r}" for i, (w, x) in enumerate(zip(names, genome, strict=True))]
