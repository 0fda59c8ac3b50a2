"""Structured Streaming over the event log.

* :func:`start_window_stats`: ``readStream`` of the events table,
  ``withWatermark`` + daily ``window`` per event type, counted and summed in
  update mode. Old windows leave the state store once the watermark passes
  them, so state stays bounded on an endless stream. Each micro-batch's updated
  rows are appended, with the batch id, to a Parquet table by ``foreachBatch``;
  :func:`latest_window_stats` reads the latest value per window.
* :func:`start_drift_monitor`: ``foreachBatch`` runs the drift operator (D3) on
  each micro-batch against a fixed reference sample and appends the drift table
  with the batch id.

Sinks write Parquet under the shared checkpoint folder, and so do the
streaming checkpoints, so a restarted query resumes where it stopped; the
batch id makes the appends idempotent on replay (rows of a replayed batch are
superseded by ``max_by`` over the batch id, or written under the same
``batch_id=`` partition with overwrite).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import ntz_as_utc_instant, utc_instant_as_ntz
from ..session import ensure_checkpoint_dir
from ..sources.tables import read_table

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/ebb-stream/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The events table of ``sf_dir`` as a stream (new files are new data)."""
    r = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events*.parquet")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(sf_dir)


def window_stats(events: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    # watermarks need a zoned timestamp: the wall time read as UTC, so windows
    # fall on wall-clock boundaries whatever the session time zone
    ev = events.withColumn("event_time", ntz_as_utc_instant(F.col("ts")))
    return (ev.withWatermark("event_time", watermark)
            .groupBy(F.window("event_time", window).alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("n_events"),
                 F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total_value")))


def _upsert_batches(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .parquet(f"{path}/batch_id={batch_id}"))
    return write


def start_window_stats(spark: SparkSession, sf_dir: str, out_path: str | None = None,
                       checkpoint: str | None = None, window: str = "1 day",
                       watermark: str = "1 hour", available_now: bool = True):
    """Start the windowed-statistics stream; returns (query, out_path)."""
    out_path = out_path or _scratch(spark, "window-stats")
    checkpoint = checkpoint or _scratch(spark, "window-stats-ckpt")
    stats = window_stats(event_stream(spark, sf_dir), window, watermark).select(
        utc_instant_as_ntz(F.col("w.start")).alias("window_start"),
        utc_instant_as_ntz(F.col("w.end")).alias("window_end"),
        "event_type", "n_events", "total_value")
    w = (stats.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(_upsert_batches(out_path)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(), out_path


def latest_window_stats(spark: SparkSession, out_path: str) -> DataFrame:
    """The latest row per (window, event type) over all written batches."""
    df = spark.read.parquet(out_path)
    keys = ["window_start", "window_end", "event_type"]
    latest = df.groupBy(*keys).agg(F.max_by(F.struct("n_events", "total_value"), "batch_id").alias("v"))
    return latest.select(*keys, "v.n_events", "v.total_value")


def start_drift_monitor(spark: SparkSession, sf_dir: str, reference: DataFrame, features: dict,
                        out_path: str | None = None, checkpoint: str | None = None,
                        available_now: bool = True):
    """Drift of each micro-batch of events against ``reference``.

    ``features`` maps output names to column expressions over the event
    columns; ``reference`` must already hold those names.
    """
    from ..operators.drift import detect_drift
    out_path = out_path or _scratch(spark, "drift")
    checkpoint = checkpoint or _scratch(spark, "drift-ckpt")
    names = list(features)
    ref = reference.select(*names)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        cur = batch.select(*[expr.alias(n) for n, expr in features.items()])
        (detect_drift(ref, cur, names).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}"))

    w = (event_stream(spark, sf_dir).writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(on_batch))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(), out_path


def run_window_stats(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """Run the stream over the data present now and return the final stats."""
    q, out = start_window_stats(spark, sf_dir, **kw)
    q.awaitTermination()
    return latest_window_stats(spark, out)


def run_drift_monitor(spark: SparkSession, sf_dir: str, reference: DataFrame, features: dict) -> DataFrame:
    q, out = start_drift_monitor(spark, sf_dir, reference, features)
    q.awaitTermination()
    return spark.read.parquet(out)


def reference_first_half(spark: SparkSession, sf_dir: str, features: dict) -> DataFrame:
    """Events up to the median event id, as the drift reference."""
    from ..operators.drift import split_halves
    ev = read_table(spark, sf_dir, "events")
    ref, _ = split_halves(ev, "event_id")
    return ref.select(*[expr.alias(n) for n, expr in features.items()])
