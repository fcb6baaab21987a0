"""Shared pieces: tables in the shared folder, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shingles import mix

SMALL = 1_000_000  # rows of a table that may be broadcast
HEAVY = 10_000  # rows of a key that are no longer dealt by it
CHUNK = 1_000_000  # edges that are contracted at a time


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share.

    The session's ``spark.checkpoint.dir``; only where that is unset (a local
    session, as in tests) one of our own, which is then set for later calls.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/larkspur-{spark.sparkContext.applicationId}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and return a reader of it.

    This cuts the lineage: a lost executor costs the tasks that read the files, not
    what made them.  ``discard`` deletes a table again, ``forget`` all of a session.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``save`` returned and that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._saved_at)


def forget(spark: SparkSession) -> None:
    """Delete every table that ``save`` wrote in this application."""
    _delete(spark, own_dir(spark))


def lookup(rows: DataFrame, table: DataFrame, on: str, weight: str) -> DataFrame:
    """rows left-joined with table, which has each key once, whatever number of rows a key has.

    A table of up to ``SMALL`` keys is broadcast.  Of a larger one only keys with a weight
    (their number of rows) of over ``HEAVY`` are, which are fewer than rows / HEAVY; rows that
    those serve are dealt by chance in the join with the rest.  The weight isn't returned.
    """
    values = [c for c in table.columns if c not in (on, weight)]
    if table.count() <= SMALL:
        return rows.join(F.broadcast(table.drop(weight)), on, "left")
    heavy = table.where(F.col(weight) > HEAVY).select(F.col(on), F.struct(*values).alias("_heavy"))
    light = table.where(F.col(weight) <= HEAVY).select(F.col(on).alias("_key"), F.struct(*values).alias("_light"))
    first = rows.join(F.broadcast(heavy), on, "left")
    spread = F.when(F.col("_heavy").isNull() & F.col(on).isNotNull(), F.col(on)).otherwise(F.xxhash64(*rows.columns))
    both = first.withColumn("_at", spread).join(light, F.col("_at") == F.col("_key"), "left")
    found = F.when(F.col("_heavy").isNotNull(), F.col("_heavy")).when(F.col("_at") == F.col(on), F.col("_light"))
    return both.withColumn("_found", found).select(*rows.columns, *[F.col("_found")[c].alias(c) for c in values])


def _forest(salt: int):
    """(node, root) of each chunk of edges: root is the node of least priority that a reaches by edges of the chunk."""

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        order = np.argsort(mix(nodes.view(np.uint64) ^ np.uint64(salt)), kind="stable")
        rank = np.empty(len(nodes), np.int64)
        rank[order] = np.arange(len(nodes))
        x, y = rank[at[: len(a)]], rank[at[len(a) :]]
        root = np.arange(len(nodes))
        while True:
            p, q = root[x], root[y]
            if (p == q).all():
                break
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
            while (root[root] != root).any():
                root = root[root]
        return pa.RecordBatch.from_arrays([pa.array(nodes[order]), pa.array(nodes[order][root])], names=["node", "root"])

    def run(it):
        held, size = [], 0
        for batch in it:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size > CHUNK:
                yield stars(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield stars(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root), once for every node of an edge (a, b): nodes have one root if edges join them, and only then.

    Each task contracts its chunks of edges to stars.  A node takes the root of least
    priority among those of its chunks; its other roots are joined to that one by edges of
    the next round, in which only roots are left.  Nodes are grouped by themselves and stand once in a chunk,
    so a hub is no hot key.  Priorities are hashes that change with the round, so about a third of the
    nodes leave in each, whatever their numbers.  The edges stay distributed, only a count comes to the driver.
    """
    levels = []
    while True:
        # sorted, so that a task that is run again makes the same chunks
        stars = edges.select("a", "b").where("a <> b").sortWithinPartitions("a", "b").mapInArrow(_forest(len(levels)), "node long, root long")
        rows = save(stars.withColumn("m", F.expr("min(root) OVER (PARTITION BY node)")), name)
        levels.append(rows)
        edges = rows.where("root <> m").select(F.col("root").alias("a"), F.col("m").alias("b")).distinct()
        if edges.isEmpty():
            break
    found = None
    for rows in reversed(levels):
        parents = rows.groupBy("node").agg(F.min("m").alias("m"))
        if found is None:
            found = parents.select("node", F.col("m").alias("root"))
        else:
            up = found.select(F.col("node").alias("m"), "root")
            small = up.count() <= SMALL
            found = parents.join(F.broadcast(up) if small else up, "m", "left").select("node", F.coalesce("root", "m").alias("root"))
        found = save(found, name)
    discard(*levels)
    return found
