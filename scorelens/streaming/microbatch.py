"""Producer side: replay a table as micro-batch files plus trigger rows.

Rows get a micro-batch id from a schedule (constant, increasing, random sizes),
are written as JSON-array files, one array in one file per micro-batch whatever its
size, and one trigger row per micro-batch is
appended to the tracker's trigger log. Nothing is read back and rewritten, so
producers and consumers never lose each other's tracker rows.
"""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StructField, StructType

from scorelens.operators import rows
from scorelens.operators.centroid import settled
from scorelens.sources.sinks import write_json_array_files

IMAGE_SCHEMA = StructType([
    StructField("id", LongType(), True),
    StructField("idx", LongType(), True),
    StructField("data", ArrayType(FloatType()), True),
    StructField("label", IntegerType(), True),
])


def schedule(df: DataFrame, order: list[Column], kind: str, size: int = 5, lo: int = 50,
             hi: int = 200) -> DataFrame:
    """Add ``batch_id`` (from 1) and ``rn`` by the producer's schedule."""
    if kind == "constant":
        out = rows.with_row_number(df, order)
        return out.withColumn("batch_id", rows.constant_batch(F.col("rn"), size) + 1)
    if kind == "increasing":
        out = rows.with_row_number(df, order)
        return out.withColumn("batch_id", rows.increasing_batch(F.col("rn"), size))
    if kind == "random":
        return rows.assign_random(df, order, lo, hi)
    raise ValueError(f"unknown schedule {kind}")


def produce_micro_batches(df: DataFrame, input_dir: str, tracker_dir: str, order: list[Column],
                          kind: str = "increasing", size: int = 5,
                          producer: str | None = None, model: str | None = None,
                          env: str | None = None) -> DataFrame:
    """Write image rows (data, label) as micro-batch files; ``idx`` = micro-batch id.

    Trigger rows go to ``tracker_dir/triggers/by=p_<name>`` with overwrite:
    producers never touch each other's rows, and re-running a producer after a
    failure replaces its own rows instead of duplicating them. The name defaults
    to a hash of ``input_dir`` (as the consumer's does), so batches of different
    producers stay apart although each numbers its own from 1. Rows carry
    ``model`` and ``env``. Micro-batch files refuse to overwrite.
    """
    sched = schedule(df, order, kind, size)
    name = producer or producer_of(input_dir)
    _write(sched, input_dir, "errorifexists")
    triggers = _triggers(sched, name, model, env)
    triggers.write.mode("overwrite").parquet(f"{tracker_dir}/triggers/by=p_{name}")
    return triggers


def push_micro_batches(df: DataFrame, input_dir: str, tracker_dir: str, order: list[Column], kind: str = "increasing", size: int = 5,
                       per_push: int = 1, interval_s: float = 0.0, producer: str | None = None, model: str | None = None,
                       env: str | None = None) -> int:
    """The same micro-batches pushed a few at a time into a growing folder; returns how many pushes it took.

    Each push first appends its trigger rows, then its files, as a producer does that logs before it sends; a push
    has folders of its own, so a reader at any moment finds whole pushes.
    """
    sched = settled(schedule(df, order, kind, size))
    last = sched.agg(F.max("batch_id")).first()[0] or 0
    name = producer or producer_of(input_dir)
    pushes = range(1, last + 1, per_push)
    for n, first in enumerate(pushes):
        if n:
            time.sleep(interval_s)
        part = sched.where((F.col("batch_id") >= first) & (F.col("batch_id") < first + per_push))
        _triggers(part, name, model, env).write.mode("overwrite").parquet(f"{tracker_dir}/triggers/by=p_{name}_{n}")
        _write(part, input_dir, "append")
    return len(pushes)


def _write(sched: DataFrame, input_dir: str, mode: str) -> None:
    files = sched.select("batch_id", "rn", F.col("id").cast("bigint").alias("id"), F.col("batch_id").alias("idx"),
                         F.col("data").cast("array<float>").alias("data"), F.col("label").cast("int").alias("label"))
    write_json_array_files(files, input_dir, "batch_id", order=["rn"], hidden=["rn"], mode=mode)


def _triggers(sched: DataFrame, producer: str, model: str | None, env: str | None) -> DataFrame:
    return sched.groupBy("batch_id").agg(F.count(F.lit(1)).alias("batch_size")).select(
        "batch_id", "batch_size", F.lit(time.time()).alias("triggered"), F.lit(producer).alias("producer"),
        F.lit(model).cast("string").alias("model"), F.lit(env).cast("string").alias("env"))


def producer_of(input_dir: str) -> str:
    """The default producer name of an input folder."""
    return hashlib.md5(input_dir.rstrip("/").encode()).hexdigest()[:16]
