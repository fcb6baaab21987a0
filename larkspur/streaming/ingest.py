"""Streams: keyword capture, batched drains, and windowed counts.

Windowed counts over events, with watermarks, go beyond what short-text research needs.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tracked(text: Column, keywords: list[str], retweets: bool = False) -> Column:
    """Text that holds one of the keywords as they are written, and isn't a retweet."""
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.contains(text, F.lit(k))
    return hit if retweets else hit & ~text.startswith("RT ")


def capture(stream: DataFrame, keywords: list[str], language: str | None = "en") -> DataFrame:
    """Rows (identifier, document, lang) of a stream or table worth keeping."""
    out = stream.where(tracked(F.col("document"), keywords))
    return out.where(F.col("lang") == language) if language else out


def move(batch: DataFrame, number: int, target: str, least: int) -> None:
    """Take in one batch, and move all that waits to target/batch=number once it is ``least`` rows.

    A batch is first written under its number beside target; a manifest for the number, written last, says which
    numbers wait after it.  Every step before the manifest writes the same again if the batch comes
    again, and a batch that has its manifest is left alone, so rows are neither lost nor doubled.
    """
    spark = batch.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    manifests, held = f"{target}-manifests", f"{target}-held"
    done = [int(f.getPath().getName()) for f in fs.listStatus(path(manifests))] if fs.exists(path(manifests)) else []
    if number in done:
        return
    waiting: list[int] = []
    if done:
        stream = fs.open(path(f"{manifests}/{max(done)}"))
        try:
            waiting = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
    batch.write.mode("overwrite").parquet(f"{held}/batch={number}")
    waiting = sorted({*waiting, number})
    rows = spark.read.schema(batch.schema).parquet(*(f"{held}/batch={k}" for k in waiting))
    moved = rows.count() >= least
    if moved:
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")
    # whole or not at all: a manifest has its name only once it is written
    temporary = path(f"{target}-temporary/{uuid.uuid4().hex}")
    stream = fs.create(temporary, True)
    try:
        stream.write(bytearray(json.dumps([] if moved else waiting).encode()))
    finally:
        stream.close()
    fs.mkdirs(path(manifests))
    fs.rename(temporary, path(f"{manifests}/{number}"))
    if moved:
        for k in waiting:
            fs.delete(path(f"{held}/batch={k}"), True)


def drain(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, least: int = 500) -> StreamingQuery:
    """Move what has arrived into Parquet, each row once, and stop.

    A batch below ``least`` rows waits beside the target and joins the next one.
    """
    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(lambda batch, number: move(batch, number, target, least)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def show(stream: DataFrame, checkpoint: str) -> StreamingQuery:
    """Print who writes what, row by row, and stop when all that has arrived is printed."""
    lines = stream.select(F.concat_ws(" : ", "user", "document").alias("line"))
    return lines.writeStream.format("console").option("truncate", "false").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, event_type, n, total: tumbling windows; a stream drops rows later than the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, session_start, session_end, n: runs of a user's events no further apart than the gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
