"""Jobs as streams: files that arrive become jobs, their states a running table, their number a trigger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slateledger.sources.ingest import guarded

STATES = ("queued", "processing", "complete", "failed")


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of new files of accepted kinds and sizes."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return guarded(spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)).where("reason is null").drop("reason")


def latest(events: DataFrame) -> DataFrame:
    """events (job_id, ts, status, percent, message), batch or stream: each job's last state; of equal times the further one."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("status"))
    return events.groupBy("job_id").agg(F.max(F.struct("ts", rank.alias("r"), "status", "percent", "message")).alias("s")).select("job_id", "s.ts", "s.status", "s.percent", "s.message")


def windowed(events: DataFrame, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Beyond the reference: states counted by time window, late events within a bound included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "status").agg(F.count("*").alias("n")).select("window.start", "window.end", "status", "n")


def paired(local: DataFrame, service: DataFrame, batch: str, order: list[str]) -> DataFrame:
    """Local jobs with the service's job at the same place of their batch; its columns are null where it has fewer."""
    at = lambda df: df.withColumn("_at", F.row_number().over(Window.partitionBy(batch).orderBy(*order)))
    return at(local).join(at(service).drop(*order), [batch, "_at"], "left").drop("_at")


def run(stream: DataFrame, handle: Callable[[DataFrame, int], DataFrame], status_path: str, checkpoint: str, progress: Callable[[int, str, int], None] | None = None) -> StreamingQuery:
    """Every micro-batch through `handle` (files to rows of doc_id and the record columns); states appended.

    A batch that fails is tried again with the same files by the stream's own recovery. `progress` is told
    (number of the batch, state, per cent) on the driver as it goes on.
    """
    tell = progress or (lambda *_: None)

    def batch(files: DataFrame, number: int) -> None:
        jobs = files.select(F.sha2("path", 256).alias("job_id"), "path")
        at = lambda s, p: jobs.select("job_id", F.current_timestamp().alias("ts"), F.lit(s).alias("status"), F.lit(p).alias("percent"), F.col("path").alias("message"))
        tell(number, "processing", 10)
        at("processing", 10).write.mode("append").parquet(status_path)
        done = handle(files, number).select(F.col("doc_id").alias("_id")).distinct()
        at("complete", 100).join(done, F.col("job_id") == F.col("_id"), "left").withColumn("status", F.when(F.col("_id").isNull(), "failed").otherwise("complete")).drop("_id").write.mode("append").parquet(status_path)
        tell(number, "complete", 100)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def triggers(before: int, new: int, every: int = 5) -> list[int]:
    """The counts between `before` and `before + new` at which a training run is due."""
    return list(range((before // every + 1) * every, before + new + 1, every))
