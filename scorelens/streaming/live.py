"""Producer and consumers that run at the same time on one growing folder and one tracker."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.streaming.scoring import start_scoring_stream
from scorelens.streaming.tracker import TRIGGERS, read_log, tracker_view

POLL_S = 0.25


def await_tracker(spark: SparkSession, tracker_dir: str, timeout_s: float = 120.0) -> None:
    """The barrier of a consumer: wait until a producer has logged its first trigger."""
    until = time.monotonic() + timeout_s
    while not read_log(spark, f"{tracker_dir}/triggers", TRIGGERS).limit(1).count():
        if time.monotonic() > until:
            raise TimeoutError(f"no producer has begun within {timeout_s}s")
        time.sleep(POLL_S)


def run_live(spark: SparkSession, produce: Callable[[], object], input_dir: str, model: DataFrame, tracker_dir: str, checkpoints: dict[str, str],
             max_files_per_trigger: int = 1, timeout_s: float = 600.0, producer: str | None = None) -> None:
    """Run ``produce`` beside one consumer for each name in ``checkpoints`` until every consumer has scored every pushed row.

    Each consumer waits at the barrier, then scores the folder as it grows. Once the producer has returned, a consumer is
    done when its scored rows are the pushed ones; an error of any of them, or the timeout, ends the run.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(input_dir)  # consumers may start before the first file
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    until, closed, failed = time.monotonic() + timeout_s, threading.Event(), []

    def guarded(work):
        def run():
            try:
                work()
            except Exception as problem:  # noqa: BLE001 - raised again by the caller's thread
                failed.append(problem)
        return run

    def produced() -> None:
        try:
            produce()
        finally:
            closed.set()

    def consumed(name: str) -> None:
        await_tracker(spark, tracker_dir, timeout_s)
        query, _ = start_scoring_stream(spark, input_dir, model, tracker_dir, checkpoints[name], max_files_per_trigger, producer=producer, consumer=name)
        try:
            while not failed:
                if query.exception() is not None:
                    raise RuntimeError(str(query.exception()))
                if closed.wait(POLL_S):
                    query.processAllAvailable()
                    if _missing(spark, tracker_dir, name) == 0:
                        return
                if time.monotonic() > until:
                    raise TimeoutError(f"consumer {name} has not scored all rows within {timeout_s}s")
        finally:
            query.stop()

    threads = [threading.Thread(target=guarded(produced)), *[threading.Thread(target=guarded(lambda n=n: consumed(n))) for n in checkpoints]]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if failed:
        raise failed[0]


def _missing(spark: SparkSession, tracker_dir: str, consumer: str) -> int:
    """Pushed rows that the consumer has not scored."""
    view = tracker_view(spark, tracker_dir, by_consumer=True)
    pushed = read_log(spark, f"{tracker_dir}/triggers", TRIGGERS).agg(F.sum("batch_size")).first()[0] or 0
    return pushed - (view.where(F.col("consumer") == f"c_{consumer}").agg(F.sum("scored")).first()[0] or 0)
