"""Rows, start and end of every trigger of a stream, as append-only rows beside the tracker."""

from __future__ import annotations

import datetime
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from scorelens.streaming.tracker import read_log

TRIGGER_LOG = "run string, epoch long, rows long, started double, ended double"
KEPT = 100  # triggers that the driver holds before they are written


class TriggerLog(StreamingQueryListener):
    """Listens to the query named ``name`` and writes a row for each of its triggers that ran a batch."""

    def __init__(self, spark: SparkSession, name: str, tracker_dir: str):
        self.spark, self.name, self.tracker_dir = spark, name, tracker_dir
        self.lock, self.over, self.rows, self.run, self.parts = threading.Lock(), threading.Event(), [], None, 0

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = str(event.runId)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name != self.name or "addBatch" not in progress.durationMs:
            return
        started = datetime.datetime.fromisoformat(progress.timestamp.replace("Z", "+00:00")).timestamp()
        ended = started + progress.durationMs.get("triggerExecution", 0) / 1000.0
        with self.lock:
            self.rows.append((str(progress.runId), int(progress.batchId), int(progress.numInputRows), started, ended))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run:
            self.over.set()

    def flush(self, least: int = KEPT) -> None:
        """Append the triggers seen so far, if there are ``least`` of them."""
        with self.lock:
            if len(self.rows) < least:
                return
            rows, self.rows, part = self.rows, [], self.parts
            self.parts += 1
        self.spark.createDataFrame(rows, TRIGGER_LOG).coalesce(1).write.mode("overwrite").parquet(f"{self.tracker_dir}/progress/part=r_{self.run}_{part}")

    def close(self, timeout_s: float = 30.0) -> None:
        """Wait for the query's last event and write what is left."""
        self.over.wait(timeout_s)
        self.flush(1)


def trigger_log(spark: SparkSession, tracker_dir: str) -> DataFrame:
    return read_log(spark, f"{tracker_dir}/progress", TRIGGER_LOG).select("run", "epoch", "rows", "started", "ended")
