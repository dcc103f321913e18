"""Tracker view over the append-only trigger and result logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIGGERS = "batch_id long, batch_size long, triggered double, producer string, model string, env string"
RESULTS = "producer string, batch_id long, n long, hits long, start double, `end` double"


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only log as far as it is written; no rows if nobody has begun it."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def tracker_view(spark: SparkSession, tracker_dir: str, by_consumer: bool = False) -> DataFrame:
    """One row per producer and micro-batch: its trigger joined with the consumers' results.

    Results are summed per batch over consumers and epochs (a batch split over several
    files or triggers), so replays that overwrite their own epoch never double count. Unfinished
    batches keep start = end = 0 and accuracy 0. With ``by_consumer`` consumers that score the same batches have
    rows of their own (column ``consumer``, null where nobody has scored the batch yet).
    """
    own = ["consumer"] if by_consumer else []
    triggers = read_log(spark, f"{tracker_dir}/triggers", TRIGGERS).groupBy("producer", "batch_id").agg(
        F.sum("batch_size").alias("batch_size"), F.min("triggered").alias("triggered"),
        F.max("model").alias("model"), F.max("env").alias("env"))
    results = read_log(spark, f"{tracker_dir}/results", RESULTS)
    if by_consumer and "consumer" not in results.columns:
        results = results.withColumn("consumer", F.lit(None).cast("string"))
    results = results.groupBy("producer", "batch_id", *own).agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.min("start").alias("start"), F.max("end").alias("end"))
    return triggers.join(results, ["producer", "batch_id"], "left").select(
        "producer", "model", "env", "batch_id", *own, F.col("batch_size").cast("bigint").alias("batch_size"), "triggered",
        F.coalesce("start", F.lit(0.0)).alias("start"), F.coalesce("end", F.lit(0.0)).alias("end"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("scored"),
        F.coalesce(F.round(F.lit(100.0) * F.col("hits") / F.col("n"), 3), F.lit(0.0)).alias("accuracy"),
    )
