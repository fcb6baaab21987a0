"""Sharding by size-tiered compaction.

A store holds immutable shards, each a folder of Parquet files, and one manifest
for each version: the list of its shards with their rows and bytes.  Every arrival is
appended as a small shard, by a version of its own.  Compaction looks at tiers: shards whose sizes are
within a factor of ``FAN_IN``.  ``FAN_IN`` shards of a tier are merged into one, of files
of about the target size; shards of half the target size are left alone, so a row is
rewritten about log(target / arrival) times at most.

A version comes into being by renaming its manifest to a name that must not exist yet, which
HDFS and local file systems do whole or not at all; a reader sees either version.  A
writer that finds its version made by another one takes up that version and tries again; merges
whose shards another writer has replaced meanwhile are given up.  Nothing is deleted by appends
or merges: readers of older versions keep their files, and so do writers between their write
and their commit.  ``vacuum`` deletes what no recent manifest names once it has a given age.

Rows are written and merged by Spark's own readers and writers.  Nulls, empty and very long
texts, ties and repeated rows are kept as they are; no rows make no shard, but a version that
knows the schema; columns may have any names, as the store's own avoid them.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAN_IN = 4
TARGET = 128 << 20
LEAST_TIER = 1 << 20  # smaller shards share the lowest tier
JOBS = 8  # merges that run side by side
AGE = 24 * 3600  # seconds for which readers and writers may use files that no recent version names


class LostRace(Exception):
    """Another writer made the version."""


class ShardStore:
    """A versioned store of shards below root, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fan_in: int = FAN_IN):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target, fan_in
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.root).getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _bytes(self, path: str) -> int:
        return self.fs.getContentSummary(self._path(path)).getLength()

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        folder = self._path(f"{self.root}/manifests")
        if not self.fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "shards": []}
        stream = self.fs.open(self._path(f"{self.root}/manifests/v{version:09d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: dict, shards: list[dict], schema: str) -> dict:
        """Make the version after base; ``LostRace`` if another writer made it first."""
        made = {"version": base["version"] + 1, "schema": schema, "shards": shards}
        temporary = self._path(f"{self.root}/temporary/{uuid.uuid4().hex}")
        stream = self.fs.create(temporary, True)
        try:
            stream.write(bytearray(json.dumps(made).encode()))
        finally:
            stream.close()
        self.fs.mkdirs(self._path(f"{self.root}/manifests"))
        files = self.jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(getattr(files, "Options$Rename"), 0)
        try:
            files.FileContext.getFileContext(temporary.toUri(), self.conf).rename(temporary, self._path(f"{self.root}/manifests/v{made['version']:09d}.json"), options)
        except Py4JJavaError as e:
            self.fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise LostRace(f"version {made['version']} exists") from e
            raise
        return made

    def _add(self, shards: list[dict], schema: str) -> dict:
        """A version with further shards, after whatever version is the newest."""
        while True:
            base = self.manifest()
            if base["schema"] is not None and base["schema"] != schema:
                raise ValueError("arrivals have another schema than the store")
            try:
                return self.commit(base, [*base["shards"], *shards], schema)
            except LostRace:
                continue

    def append(self, arrivals: DataFrame, batch: str | None = None) -> dict:
        """Append arrivals as a shard; with the column batch, which isn't kept itself, each of its values is an arrival.

        Arrivals that are at hand together are written by one job, files of a batch split where they are
        large; each is then committed as a version of its own.  The newest manifest is returned.
        """
        key = "_batch"
        while key in arrivals.columns:
            key += "_"
        rows = arrivals.withColumn(key, F.col(batch).cast("string") if batch else F.lit("0"))
        if batch:
            rows = rows.drop(batch)
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields if f.name != key])
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.hint("rebalance", key).write.partitionBy(key).parquet(path)
        shards = self._written(path)
        for shard in shards:
            last = self._add([shard], schema.json())
        return last if shards else self._add([], schema.json())

    def _written(self, path: str) -> list[dict]:
        """The shards below a folder, a folder each: path, rows (from the files' footers) and bytes."""
        found = sorted(str(s.getPath().toString()) for s in self.fs.listStatus(self._path(path)) if s.isDirectory())
        if not found:
            return []
        counts = self.spark.read.schema(T.StructType([])).option("basePath", path).parquet(*found).groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("at")).count()
        rows = {r["at"]: r["count"] for r in counts.collect()}
        name = lambda p: p.rpartition("/")[2]
        quoted = {name(self.jvm.org.apache.hadoop.fs.Path(p).toUri().getRawPath()): name(p) for p in found}
        rows = {quoted.get(k, k): n for k, n in rows.items()}
        return [{"path": p, "rows": rows.get(name(p), 0), "bytes": self._bytes(p)} for p in found]

    def tier(self, size: int) -> int:
        return int(math.log(max(size, LEAST_TIER) / LEAST_TIER, self.fan_in))

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Groups of ``fan_in`` shards of one tier, smallest tiers first; none of half the target size."""
        tiers: dict[int, list[dict]] = {}
        for s in sorted(shards, key=lambda s: s["bytes"]):
            if 2 * s["bytes"] < self.target:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        return [group[i : i + self.fan_in] for _, group in sorted(tiers.items()) for i in range(0, len(group) - self.fan_in + 1, self.fan_in)]

    def compact(self) -> dict:
        """Merge until no tier has ``fan_in`` shards; the merges of a round run side by side and make one version."""
        while True:
            base = self.manifest()
            groups = self.plan(base["shards"])
            if not groups:
                return base
            schema = T.StructType.fromJson(json.loads(base["schema"]))
            path = f"{self.root}/data/{uuid.uuid4().hex}"

            def merge(k: int) -> None:
                files = max(1, -(-sum(s["bytes"] for s in groups[k]) // self.target))
                self.spark.read.schema(schema).parquet(*(s["path"] for s in groups[k])).coalesce(int(files)).write.parquet(f"{path}/merge={k}")

            with ThreadPoolExecutor(JOBS) as pool:
                list(pool.map(inheritable_thread_target(self.spark)(merge), range(len(groups))))
            self._replace(groups, self._written(path))

    def _replace(self, groups: list[list[dict]], made: list[dict]) -> None:
        """A version with merged shards in place of theirs, unless another writer has replaced one of those."""
        gone = {s["path"] for g in groups for s in g}
        while True:
            base = self.manifest()
            if not gone <= {s["path"] for s in base["shards"]}:
                return
            try:
                self.commit(base, [s for s in base["shards"] if s["path"] not in gone] + made, base["schema"])
                return
            except LostRace:
                continue

    def vacuum(self, keep: int = 1, age: float = AGE) -> None:
        """Delete data that no manifest of the newest keep names and that was written over age seconds ago.

        Readers of older versions, and writers between write and commit, must not take longer than that.
        """
        last = self.version()
        used = {s["path"] for v in range(max(1, last - keep + 1), last + 1) for s in self.manifest(v)["shards"]}
        names = {self.fs.makeQualified(self._path(u)).toString() for u in used}
        before = (time.time() - age) * 1000
        folder = self._path(f"{self.root}/data")
        for run in self.fs.listStatus(folder) if self.fs.exists(folder) else []:
            at = run.getPath()
            if run.getModificationTime() > before:
                continue
            inner = [s.getPath() for s in self.fs.listStatus(at) if s.isDirectory()]
            if not any(p.toString() in names for p in inner):
                self.fs.delete(at, True)
                continue
            for p in inner:
                if p.toString() not in names:
                    self.fs.delete(p, True)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        m = self.manifest(version)
        schema = T.StructType.fromJson(json.loads(m["schema"])) if m["schema"] else T.StructType([])
        if not m["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(s["path"] for s in m["shards"]))
