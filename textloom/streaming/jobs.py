"""Streams: debounced file changes, throttled progress, windows over events."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema: str, at: str = "ts", files: int | None = None) -> DataFrame:
    """Events of Parquet files as they come; times without a zone are taken as UTC, which watermarks need."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path).withColumn(at, F.col(at).cast("timestamp"))


def debounce(events: DataFrame, key: str, at: str = "ts", quiet: str = "1 second", late: str | None = "10 minutes") -> DataFrame:
    """One row for each burst of changes: a burst ends when nothing came for ``quiet``.

    Batch or stream; a stream gives a burst once the watermark has passed it.
    """
    if late:
        events = events.withWatermark(at, late)
    grouped = events.groupBy(key, F.session_window(at, quiet).alias("w")).agg(F.count("*").alias("changes"))
    return grouped.select(key, F.col("w.start").alias("first_at"), F.col("w.end").alias("due_at"), "changes")


def throttle(progress: DataFrame, run: str = "run_id", every_ms: int = 500) -> DataFrame:
    """Progress rows (run, stage, processed, status, at_ms) that are written: every half second, and always when the
    stage changes or the run ends.  State: a run's last time and stage, dropped at its end or after an idle hour."""
    schema = f"{run} bigint, stage string, processed bigint, status string, at_ms bigint"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, stage = state.get if state.exists else (None, None)
        rows = pd.concat(list(parts)).sort_values("at_ms", kind="stable")
        kept, ended = [], False
        for r in rows.itertuples(index=False):
            over = r.status not in ("queued", "running")
            if last is None or over or r.stage != stage or r.at_ms - last >= every_ms:
                kept.append(r)
                last, stage = int(r.at_ms), r.stage
            ended = ended or over
        if ended:
            state.remove()
        else:
            state.update((last, stage))
            state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame(kept, columns=list(rows.columns)) if kept else rows.iloc[:0]

    rows = progress.select(run, "stage", F.col("processed").cast("bigint").alias("processed"), "status", F.col("at_ms").cast("bigint").alias("at_ms"))
    return rows.groupBy(run).applyInPandasWithState(step, schema, "last bigint, stage string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, by: str, at: str = "ts", width: str = "1 hour", slide: str | None = None, late: str | None = "10 minutes") -> DataFrame:
    """Counts by window and key, tumbling or sliding; late rows within the watermark still count."""
    if late:
        events = events.withWatermark(at, late)
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return events.groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("from_at"), F.col("w.end").alias("to_at"), by, "n")


def deduplicated(events: DataFrame, keys: list[str], at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each event once, for as long as the watermark remembers it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def every(stream: DataFrame, seconds: int | None, job: Callable[[DataFrame, int], None], checkpoint: str, active: Callable[[], bool] = lambda: False, patience: float = 3600):
    """Run a job over each micro-batch: each ``seconds``, or once over what is there.

    While another run is active a batch waits for it, ``patience`` seconds at
    most, and then fails: it isn't committed, so that its rows come again when
    the stream is started anew.
    """

    def batch(df: DataFrame, number: int) -> None:
        until = time.monotonic() + patience
        while active():
            if time.monotonic() > until:
                raise TimeoutError(f"batch {number} waited {patience} seconds for an active run")
            time.sleep(0.1)
        job(df, number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
