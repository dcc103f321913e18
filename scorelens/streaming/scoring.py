"""Consumer side: score each micro-batch in place inside ``foreachBatch``.

* one file per trigger (``maxFilesPerTrigger``), optional archive of consumed files;
* explicit checkpoint location (restart resumes, a rerun adds nothing);
* batch identity ``coalesce(nullif(idx, 0), epoch id)``, grouped so one trigger
  may hold several micro-batches; empty triggers write nothing. With ``identity="file"`` a row
  without idx gets its file's place in a durable map (:mod:`scorelens.streaming.source_log`) instead;
* with ``keep_rejects`` records that cannot be scored go to a dead-letter table, else they are left out;
* with ``log_triggers`` every trigger's rows, start and end are logged;
* results are written to ``results/consumer=c_<id>/epoch=<id>`` with overwrite, so a
  replayed epoch (at-least-once delivery) replaces its own rows instead of adding
  rows, and consumers (one per checkpoint) never touch each other's.
"""

from __future__ import annotations

import hashlib
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scorelens.operators import centroid
from scorelens.operators.centroid import model_literal, model_values, predict_centroid, settled
from scorelens.streaming import source_log
from scorelens.streaming.microbatch import IMAGE_SCHEMA, producer_of
from scorelens.streaming.progress import TriggerLog
from scorelens.streaming.rejects import parse_records, write_rejects


def score_micro_batch(batch_df: DataFrame, epoch_id: int, model: DataFrame | None, tracker_dir: str,
                      size_checked: bool = False, classes: Column | None = None,
                      producer: str = "", consumer: str = "", identified: bool = False) -> int:
    """Score one micro-batch and record its per-batch results; returns rows written.

    ``identified``: rows have their ``batch_id`` already.
    """
    start = time.time()
    valid = batch_df.filter(F.col("data").isNotNull() & F.col("label").isNotNull())
    if not identified:
        valid = valid.withColumn("batch_id", F.coalesce(F.nullif(F.col("idx"), F.lit(0)), F.lit(int(epoch_id)).cast("bigint")))
    scored = predict_centroid(valid, model, vec="data", model_name="centroid",
                              size_checked=size_checked, classes=classes)
    summary = scored.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("pred") == F.col("label")).cast("int")).alias("hits"))
    # One row per micro-batch in this trigger: a bounded result, not the data.
    result = summary.collect()
    end = time.time()
    if not result:
        return 0
    spark = batch_df.sparkSession
    rows = [(producer, int(r["batch_id"]), int(r["n"]), int(r["hits"]), start, end) for r in result]
    out = spark.createDataFrame(rows, "producer string, batch_id long, n long, hits long, start double, `end` double")
    out.write.mode("overwrite").parquet(f"{tracker_dir}/results/consumer=c_{consumer}/epoch={int(epoch_id)}")
    return len(rows)


def consumer_of(checkpoint_dir: str) -> str:
    return hashlib.md5(checkpoint_dir.rstrip("/").encode()).hexdigest()[:16]


def run_scoring_stream(spark: SparkSession, input_dir: str, model: DataFrame, tracker_dir: str,
                       checkpoint_dir: str, max_files_per_trigger: int = 1,
                       archive_dir: str | None = None, timeout_s: float | None = None,
                       producer: str | None = None, **options) -> StreamingQuery:
    """Process every file present now (``availableNow``) and stop; ``timeout_s`` bounds the run if given.

    Results are keyed by the producer of ``input_dir`` and by this consumer, known by its checkpoint.
    ``options``: those of :func:`start_scoring_stream`.
    """
    query, log = start_scoring_stream(spark, input_dir, model, tracker_dir, checkpoint_dir, max_files_per_trigger, archive_dir, producer,
                                      trigger={"availableNow": True}, **options)
    query.awaitTermination(*([timeout_s] if timeout_s is not None else []))
    if query.isActive:
        query.stop()
        raise TimeoutError(f"scoring stream did not finish within {timeout_s}s")
    if log is not None:
        log.close()
        spark.streams.removeListener(log)
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return query


def start_scoring_stream(spark: SparkSession, input_dir: str, model: DataFrame, tracker_dir: str, checkpoint_dir: str,
                         max_files_per_trigger: int = 1, archive_dir: str | None = None, producer: str | None = None,
                         consumer: str | None = None, identity: str = "epoch", keep_rejects: bool = False, log_triggers: bool = False,
                         trigger: dict | None = None) -> tuple[StreamingQuery, TriggerLog | None]:
    """Start the stream (``trigger``: keywords of ``DataStreamWriter.trigger``) and return it with its trigger log, if wanted."""
    producer, consumer = producer or producer_of(input_dir), consumer or consumer_of(checkpoint_dir)
    # Folder names are no columns: a folder that is still empty has the same schema as a full one.
    reader = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).option("recursiveFileLookup", "true")
    if archive_dir:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    stream = reader.text(input_dir).select("value", "_metadata.file_path") if keep_rejects else reader.schema(IMAGE_SCHEMA).json(input_dir)
    if not keep_rejects and identity == "file":
        stream = stream.select(*IMAGE_SCHEMA.names, "_metadata.file_path")
    if "file_path" in stream.columns:
        stream = stream.withColumnRenamed("file_path", "file")
    # Reused by every trigger: checked and read once (bounded K x D), then
    # attached to each micro-batch as a literal instead of a per-trigger subquery; a larger model goes by parts.
    model = settled(model)
    classes = model_literal(model) if model_values(model) <= centroid.MAX_MODEL_VALUES else None
    name = f"scoring-{uuid.uuid4().hex[:12]}"
    log = TriggerLog(spark, name, tracker_dir) if log_triggers else None
    if log is not None:
        spark.streams.addListener(log)

    def process(batch_df: DataFrame, epoch_id: int) -> None:
        if log is not None:
            log.flush()
        held = batch_df
        if keep_rejects:  # read twice: parsed records are kept for the two
            held = parse_records(batch_df).persist()
            write_rejects(held, tracker_dir, consumer, int(epoch_id))
            batch_df = held.where(F.col("reason").isNull())
        if identity == "file":
            batch_df = source_log.identified(batch_df, source_log.register_files(spark, tracker_dir, producer, checkpoint_dir, int(epoch_id)))
        score_micro_batch(batch_df, epoch_id, None if classes is not None else model, tracker_dir, classes=classes, producer=producer, consumer=consumer,
                          identified=identity == "file")
        if keep_rejects:
            held.unpersist()

    query = (stream.writeStream.queryName(name).foreachBatch(process).option("checkpointLocation", checkpoint_dir)
             .trigger(**(trigger or {"processingTime": "500 milliseconds"})).start())
    return query, log


def stream_to_table(spark: SparkSession, input_dir: str, out_dir: str, checkpoint_dir: str,
                    max_files_per_trigger: int = 1, timeout_s: float | None = None) -> StreamingQuery:
    """Land micro-batch files as a table: each epoch writes ``epoch=<id>`` with
    overwrite, so a replayed epoch replaces its rows (exactly-once result)."""
    stream = spark.readStream.schema(IMAGE_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).json(input_dir)

    def land(batch_df: DataFrame, epoch_id: int) -> None:
        batch_df.write.mode("overwrite").parquet(f"{out_dir}/epoch={int(epoch_id)}")

    query = (stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint_dir)
             .trigger(availableNow=True).start())
    query.awaitTermination(*([timeout_s] if timeout_s is not None else []))
    if query.isActive:
        query.stop()
        raise TimeoutError(f"stream did not finish within {timeout_s}s")
    return query
