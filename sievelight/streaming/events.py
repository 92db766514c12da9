"""Telemetry as streams: replayed logs, incremental summaries, windowed roll-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.operators import telemetry
from sievelight.plans.tables import work_dir


def as_log(events: DataFrame) -> DataFrame:
    """Rows of the events table as telemetry: types are modes, values milliseconds."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        "event_id", F.when(F.col("event_id") % 10 == 0, "index_build").when(F.col("event_id") % 97 == 0, "eval_run").otherwise("search").alias("kind"),
        F.col("event_type").alias("mode"), F.col("value").cast("long").alias("total_ms"), (k % 4).cast("long").alias("results"), (k % 5 == 0).alias("fallback"),
        F.when(F.col("event_id") % 13 == 0, "boom").alias("error"), F.concat(F.lit("q"), k.cast("string")).alias("query"),
    )


def replay(spark: SparkSession, source: str, schema: str, sink: str, transform: Callable[[DataFrame], DataFrame], fmt: str = "parquet", files_per_trigger: int = 8) -> None:
    """Stream files into an append-only table until what is there has been read.

    The checkpoint makes each input file count once, also after a restart.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(source)
    writer = transform(stream).writeStream.format("parquet").option("path", f"{sink}/rows").option("checkpointLocation", f"{sink}/state")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def replayed_metrics(spark: SparkSession, source: str) -> DataFrame:
    """The per-mode roll-up of a folder of event files (or one file) that is read as a stream."""
    sink = work_dir(spark, "stream")
    schema = spark.read.parquet(source).schema
    folder, name = source.rstrip("/").rsplit("/", 1)
    place = spark._jvm.org.apache.hadoop.fs.Path(source)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        source = f"{folder}/{name}*"  # a stream reads folders and patterns
    replay(spark, source, schema, sink, as_log)
    return telemetry.by_mode(spark.read.parquet(f"{sink}/rows"))


def hourly(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts and sums per event type and tumbling window, in batch or as a stream: rows
    later than the watermark are dropped in a stream (an extension)."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    rolled = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rolled.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def follow(spark: SparkSession, source: str, schema: str, path: str, trigger: dict | None = None) -> None:
    """Keep a summary table beside an event log: each micro-batch is appended to the log
    table, and the summary made anew from it."""

    def step(batch: DataFrame, number: int) -> None:
        # A batch that is retried after a failure replaces what it wrote before.
        batch.write.mode("overwrite").parquet(f"{path}/log/batch={number}")
        log = spark.read.parquet(f"{path}/log").drop("batch")
        telemetry.by_mode(log).write.mode("overwrite").parquet(f"{path}/summary")

    stream = spark.readStream.schema(schema).json(source)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/state").trigger(**(trigger or {"availableNow": True})).start().awaitTermination()


def refresh_on_arrival(spark: SparkSession, source: str, listing: Callable[[], DataFrame], refresh: Callable[[DataFrame], dict], state: str) -> list[dict]:
    """Refresh an index when files arrive. A stream of files shows additions only, so every
    batch takes a full snapshot, whose diff also finds rewrites and deletions."""
    done: list[dict] = []

    def step(batch: DataFrame, number: int) -> None:
        done.append(refresh(listing()))

    stream = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").load(source).select("path")
    stream.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return done
