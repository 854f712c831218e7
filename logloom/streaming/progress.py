"""Progress figures of ingest runs and streaming queries."""

from __future__ import annotations

import datetime as dt
import json
import time
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import (
    QueryIdleEvent,
    QueryProgressEvent,
    QueryStartedEvent,
    QueryTerminatedEvent,
    StreamingQueryListener,
)
from pyspark.sql.streaming.query import StreamingQuery

from logloom.plans.control import Warehouse

PROGRESS_SCHEMA = (
    "query string, batch_id bigint, at string, input_rows bigint, rows_per_second double, duration_ms bigint"
)


def with_rates(
    progress: DataFrame,
    processed: str = "processed",
    total: str = "total",
    elapsed: str = "elapsed_seconds",
) -> DataFrame:
    """Adds ``records_per_second`` and ``estimated_remaining_seconds``, 0 while nothing is known."""
    rate = F.when(F.col(elapsed) > 0, F.col(processed) / F.col(elapsed)).otherwise(F.lit(0.0))
    rated = progress.withColumn("records_per_second", rate)
    left = (F.col(total) - F.col(processed)) / F.col("records_per_second")
    return rated.withColumn(
        "estimated_remaining_seconds", F.when(F.col("records_per_second") > 0, left).otherwise(F.lit(0.0))
    )


def run_progress(runs: DataFrame, now: Column) -> DataFrame:
    """Current figures of every run in the manifest."""
    ended = F.coalesce(F.col("completed_at"), now)
    elapsed = (F.unix_micros(ended) - F.unix_micros("started_at")) / 1_000_000
    counted = F.coalesce("success_count", F.lit(0)) + F.coalesce("failure_count", F.lit(0))
    return with_rates(
        runs.select(
            "id",
            "status",
            counted.alias("processed"),
            F.coalesce("success_count", F.lit(0)).alias("success"),
            F.coalesce("failure_count", F.lit(0)).alias("failed"),
            F.coalesce("total_records", counted).alias("total"),
            elapsed.alias("elapsed_seconds"),
        )
    )


LIVE_SCHEMA = "id string, unit string, processed bigint, failed bigint, total bigint, elapsed_seconds double"


def live_progress(warehouse: Warehouse, run_id: str, total_records: int | None = None) -> DataFrame:
    """One row with the figures of a run under way, from any thread of the driver that runs it.

    The status tracker knows the tasks of the run's jobs by the run's tag: processed and total are
    tasks, of the stages submitted so far, and cost the job nothing.  With ``total_records`` (from a
    preview, say) they are records in proportion.  A run that is not running has its manifest row's
    figures, see ``run_progress``; a run that has not begun has zeros.
    """
    spark = warehouse.spark
    tracker = spark.sparkContext.statusTracker()
    jobs = spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(run_id)
    infos = [info for info in (tracker.getJobInfo(job) for job in jobs) if info is not None]
    stages = {stage for info in infos for stage in info.stageIds}
    figures = [stage for stage in (tracker.getStageInfo(stage) for stage in sorted(stages)) if stage is not None]
    done = sum(stage.numCompletedTasks for stage in figures)
    failed = sum(stage.numFailedTasks for stage in figures)
    total = sum(stage.numTasks for stage in figures)
    row = warehouse.manifest().filter(F.col("id") == run_id).select("started_at", "completed_at").first()
    elapsed = 0.0
    if row and row["started_at"]:
        # time stamps come to the driver in its own zone
        elapsed = ((row["completed_at"] or dt.datetime.now()) - row["started_at"]).total_seconds()
    unit = "tasks"
    if total_records is not None:
        unit, done, total = "records", total_records * done // total if total else 0, total_records
    return with_rates(spark.createDataFrame([(run_id, unit, done, failed, total, elapsed)], LIVE_SCHEMA))


def _row(progress: dict) -> tuple:
    return (
        progress.get("name") or progress["id"],
        progress["batchId"],
        progress["timestamp"],
        progress["numInputRows"],
        progress.get("processedRowsPerSecond"),
        progress.get("batchDuration") or progress.get("durationMs", {}).get("triggerExecution"),
    )


def progress_table(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Recent progress of one query, one row per micro-batch."""
    rows = [_row(p if isinstance(p, dict) else json.loads(p.json)) for p in query.recentProgress]
    return spark.createDataFrame(rows, PROGRESS_SCHEMA)


class ProgressFeed(StreamingQueryListener):
    """Keeps the progress rows of all queries as files under ``path``.

    Rows are written once there are ``flush_rows`` of them or the oldest is ``flush_seconds`` old at
    the next event, and when a query is idle or ends; so a lost driver loses what is younger. Events
    and ``table`` come on threads of their own; writes wait for each other, as two appends to one
    folder share the committer's temporary folder and the first to end deletes it.
    """

    def __init__(self, spark: SparkSession, path: str, flush_rows: int = 1000, flush_seconds: float = 10.0):
        self._spark, self._path, self._flush_rows, self._flush_seconds = spark, path, flush_rows, flush_seconds
        self._oldest = 0.0
        self._rows: list[tuple] = []
        self._lock, self._writing = Lock(), Lock()
        self._write([])

    def _write(self, rows: list[tuple]) -> None:
        self._spark.createDataFrame(rows, PROGRESS_SCHEMA).coalesce(1).write.mode("append").parquet(self._path)

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        with self._lock:
            if not self._rows:
                self._oldest = time.monotonic()
            self._rows.append(_row(json.loads(event.progress.json)))
        if len(self._rows) >= self._flush_rows or time.monotonic() - self._oldest >= self._flush_seconds:
            self.flush()

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        self.flush()

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.flush()

    def flush(self) -> None:
        with self._writing:
            with self._lock:
                rows, self._rows = self._rows, []
            if rows:
                self._write(rows)

    def table(self) -> DataFrame:
        self.flush()
        return self._spark.read.schema(PROGRESS_SCHEMA).parquet(self._path)
