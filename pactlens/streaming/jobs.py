"""Jobs as an event log: current state, expiry, estimates, and the same state over a stream."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

T = TypeVar("T")

#: Status that each kind of event sets.
STATUS = {"signup": "queued", "view": "running", "click": "running", "purchase": "done"}
TTL_HOURS, CALL_SECONDS, CONCURRENCY = 24, 90, 12


def job_log(events: DataFrame) -> DataFrame:
    """job_id, ts, event_id, status of events (user_id, ts, event_id, event_type); other kinds of event are failures."""
    status = F
    for kind, value in STATUS.items():
        status = status.when(F.col("event_type") == kind, F.lit(value))
    return events.select(F.col("user_id").alias("job_id"), "ts", "event_id", status.otherwise(F.lit("failed")).alias("status"))


def current_state(log: DataFrame) -> DataFrame:
    """The latest status of each job, when it was set, and the number of events. On a stream it is updated with every batch."""
    return log.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("updated_at"), F.count(F.lit(1)).alias("n"))


def expired(state: DataFrame, hours: int = TTL_HOURS, now: Column | None = None) -> DataFrame:
    """Jobs not updated for `hours` before now, by default before the latest update of all."""
    if now is None:
        latest = state.agg(F.max("updated_at").alias("__now"))
        state, now = state.join(F.broadcast(latest)), F.col("__now")  # one row
    return state.filter(F.col("updated_at") < now - F.expr(f"INTERVAL {hours} HOURS")).drop("__now")


def eta_minutes(windows: Column, calls: int = 1, concurrency: int = CONCURRENCY) -> Column:
    seconds = windows * (calls * CALL_SECONDS / concurrency)
    return F.greatest(F.lit(1), F.floor(seconds / 60) + F.when(seconds % 60 > 0, 1).otherwise(0) + 1).cast("long")


def progress(done: Column, windows: Column) -> Column:
    return F.least(F.lit(95), 55 + F.floor(40 * done / windows)).cast("long")


def stream_state(spark: SparkSession, path: str, schema: StructType, delay: str = "1 day") -> DataFrame:
    """current_state over files that arrive in `path`; run it in update mode."""
    events = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return current_state(job_log(events))


def stream_expiry(log: DataFrame, hours: int = TTL_HOURS, delay: str = "0 seconds") -> DataFrame:
    """job_id and updated_at of each job, once it has not been updated for `hours` before the latest event (less `delay`), from a stream
    of log rows (job_id, ts); run it in append mode.

    A job's state is its latest time and a timer; the state leaves as the timer goes off. Events that come later than the delay allows
    count no more; one of a job that has expired, but in time, begins it anew.
    """
    kept = log.select("job_id", "ts").withWatermark("ts", delay)
    kind = log.schema["job_id"].dataType.simpleString()
    life = hours * 3_600_000

    def track(key, batches, state):
        if state.hasTimedOut:
            (latest,) = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "updated_at": [pd.Timestamp(latest, unit="us")]})
            return
        latest = max([state.get[0]] if state.exists else [], default=None)
        for rows in batches:
            last = int(rows["ts"].max().value // 1000)
            latest = last if latest is None else max(latest, last)
        state.update((latest,))
        # the timer is no earlier than the watermark allows; a job already past its time goes off with the next batch
        state.setTimeoutTimestamp(max(latest // 1000 + life, state.getCurrentWatermarkMs() + 1))

    return kept.groupBy("job_id").applyInPandasWithState(track, f"job_id {kind}, updated_at timestamp", "latest long", "append", GroupStateTimeout.EventTimeTimeout)


def run_tagged(spark: SparkSession, job_id: str, action: Callable[[], T]) -> T:
    """action() with its Spark jobs under the job's tag, so that cancel() finds them."""
    spark.sparkContext.addJobTag(f"job-{job_id}")
    try:
        return action()
    finally:
        spark.sparkContext.removeJobTag(f"job-{job_id}")


def cancel(spark: SparkSession, job_id: str) -> None:
    """Stop what runs under the job's tag; the action then fails with a cancellation."""
    spark.sparkContext.cancelJobsWithTag(f"job-{job_id}")


def stream_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as they arrive: path and text."""
    files = spark.readStream.format("text").option("wholetext", True).load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
