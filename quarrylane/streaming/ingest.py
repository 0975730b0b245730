"""Ingestion as streams: arriving files or rows become upserts, task states and windowed counts."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

#: A task's states with their progress.
PROGRESS = {"READING": 10, "PARSING": 30, "SCRUBBING": 50, "LLM": 70, "PERSIST": 90, "SUCCESS": 100, "FAILURE": 100}


def files(spark: SparkSession, folder: str, archive: str | None = None, per_trigger: int = 100) -> DataFrame:
    """A stream of files (path, modificationTime, length, content); read ones go to `archive` if it is given."""
    reader = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", per_trigger).schema("path string, modificationTime timestamp, length long, content binary")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder)


def rows(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of Parquet rows."""
    return spark.readStream.schema(schema).parquet(folder)


def _newest(rows_: DataFrame, key: str, order: list) -> DataFrame:
    return rows_.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_place = 1").drop("_place")


def _stored(spark: SparkSession, store: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    return spark.read.parquet(store) if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path) else None


def latest_versions(spark: SparkSession, store: str, key: str = "id") -> DataFrame | None:
    """Each key's row from the batch that was written last; None before the first batch."""
    rows_ = _stored(spark, store)
    return None if rows_ is None else _newest(rows_, key, [F.desc("written"), F.desc("version")]).drop("stream", "version", "written")


def upsert_into(store: str, key: str, transform: Callable[[DataFrame], DataFrame], order: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch's rows, transformed, are added to the store; readers take each key's newest.

    A batch writes its own changes alone, in a folder of its stream and its number, so that its cost follows the batch, not
    the store, and streams share a store. Of rows of a batch with one key that with the largest `order` stays, of ties the
    one with the largest hash of all columns: a batch that is run again writes the same over what it wrote.
    """

    def run(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"  # kept in the checkpoint
        changes = transform(batch)
        ties = F.xxhash64(*[F.col(c) for c in changes.columns]).desc()
        newest = _newest(changes, key, [F.desc(order), ties] if order else [ties])
        newest.withColumn("written", F.lit(time.time_ns())).write.mode("overwrite").parquet(f"{store}/stream={stream}/version={number}")

    return run


def compact(spark: SparkSession, store: str, key: str = "id") -> int:
    """Merge a store's batches into one that has each key's newest row; returns how many batches there were.

    Rows keep the time they were written at: where it breaks off before the merged batches are deleted, readers see the same.
    Not to be run beside a stream that writes a batch anew.
    """
    rows_ = _stored(spark, store)
    if rows_ is None:
        return 0
    merged = [(r["stream"], r["version"]) for r in rows_.select("stream", "version").distinct().collect()]
    number = max([v for s, v in merged if s == "merged"], default=-1) + 1
    newest = _newest(rows_, key, [F.desc("written"), F.desc("version")]).drop("stream", "version")
    newest.write.mode("overwrite").parquet(f"{store}/stream=merged/version={number}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for stream, version in merged:
        path = jvm.org.apache.hadoop.fs.Path(f"{store}/stream={stream}/version={version}")
        path.getFileSystem(conf).delete(path, True)
    return len(merged)


def drain(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a stream over all there is now, then stop."""
    started = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()
    return started


def task_states(events: DataFrame, task: str = "task", state: str = "state", at: str = "ts") -> DataFrame:
    """Each task's latest state and its progress; works on a table and, in update mode, on a stream."""
    last = events.groupBy(task).agg(F.max_by(state, at).alias("state"))
    return last.withColumn("progress", F.create_map(*[F.lit(x) for pair in PROGRESS.items() for x in pair])[F.col("state")])


def weekly(events: DataFrame, at: str = "ts", late: str = "2 days") -> DataFrame:
    """Counts by seven-day window; rows later than `late` behind the newest are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, "7 days")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("week"), "n")


def unique_pairs(events: DataFrame, keys: list[str], at: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each pair within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def with_retries(rows_: DataFrame, ok: str, attempts: str = "attempts", most: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows done, rows to try again (one attempt more, its delay in seconds), and rows given up."""
    failed = rows_.where(~F.col(ok)).withColumn(attempts, F.col(attempts) + 1)
    again = failed.where(F.col(attempts) <= most).withColumn("delay_s", F.least(F.pow(F.lit(2.0), F.col(attempts)), F.lit(300.0)))
    return rows_.where(F.col(ok)), again, failed.where(F.col(attempts) > most)
