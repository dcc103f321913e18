"""Sources and sinks as round trips: write a test table, read it back, compare.

Scratch folders are fresh per call under the session's checkpoint directory.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField,
                               StructType)

from scorelens.functions.hashing import md5_bucket
from scorelens.operators.generators import explode_with_position
from scorelens.operators.relabel import normalise_by_max
from scorelens.plans import reports, testdata
from scorelens.plans.prepare_queries import TRAIN_PCT, bucket_sql
from scorelens.plans.registry import query, table
from scorelens.plans.tracker_queries import tracker_sql
from scorelens.session import scratch_path
from scorelens.sources import files, sinks

# The fields of a trainer-state document.
LOG_ENTRY = StructType([StructField(n, DoubleType()) for n in (
    "loss", "step", "eval_loss", "eval_accuracy", "eval_f1", "eval_precision", "eval_recall", "eval_runtime",
    "eval_samples_per_second", "eval_steps_per_second", "total_flos", "train_loss", "train_runtime",
    "train_samples_per_second", "train_steps_per_second")])
TRAINER_STATE = StructType([
    StructField("run_id", LongType(), False),
    StructField("segment", LongType(), False),
    StructField("offset", LongType(), False),
    StructField("total_flos", DoubleType(), False),
    StructField("train_batch_size", IntegerType(), False),
    StructField("global_step", IntegerType(), False),
    StructField("log_history", ArrayType(LOG_ENTRY), False),
])
DOCS_PER_FILE = 1_000


def _trainer_state_files(spark, d) -> str:
    """Write trainer-state documents as JSON-array files of about 1,000 documents.

    Files are bucketed by (run, segment), so a hot run's many segments spread over
    many files; the file count comes from an upper bound on the document count
    (runs + entries / segment), read from parquet metadata.
    """
    states = testdata.trainer_states(spark, d)
    docs = (table(spark, d, "orders", "o_orderkey").count()
            + -(-table(spark, d, "lineitem", "l_orderkey").count() // testdata.LOG_SEGMENT))
    n_files = max(1, -(-docs // DOCS_PER_FILE))
    doc_key = F.concat_ws("/", F.col("run_id").cast("string"), F.col("segment").cast("string"))
    path = scratch_path(spark, "trainer-state")
    sinks.write_json_array_files(states.withColumn("file", md5_bucket(doc_key, n_files, "file")),
                                 path, "file", order=["run_id", "segment"], compression="gzip")
    return path


@query("src_json_nested", """
SELECT o_orderkey AS run_id, o_totalprice AS total_flos, CAST(o_custkey % 4 * 8 + 8 AS INTEGER) AS train_batch_size,
       CAST(o_orderkey % 1000 AS INTEGER) AS global_step, count(*) AS entries
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice, o_custkey""")
def src_json_nested(spark, d):
    states = files.read_json_nested(spark, _trainer_state_files(spark, d), TRAINER_STATE)
    return states.groupBy("run_id").agg(*[F.first(c).alias(c) for c in ("total_flos", "train_batch_size", "global_step")],
                                        F.sum(F.size("log_history")).cast("bigint").alias("entries"))


@query("explode_log_history", f"""
SELECT l_orderkey AS run_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
            l_extendedprice, l_discount, l_tax, l_returnflag) - 1 AS INTEGER) AS pos, {testdata.LOG_FIELDS_SQL}
FROM lineitem""")
def explode_log_history(spark, d):
    states = files.read_json_nested(spark, _trainer_state_files(spark, d), TRAINER_STATE)
    logs = explode_with_position(states, "log_history", ["run_id", "offset"])
    return logs.select("run_id", (F.col("offset") + F.col("pos")).cast("int").alias("pos"), "log.*")


@query("src_json_lines", tracker_sql() + """
SELECT batch_id, model, env, batch_size, triggered, start, "end", accuracy FROM tracker""")
def src_json_lines(spark, d):
    path = scratch_path(spark, "tracker-json")
    sinks.write_json_lines(testdata.tracker(spark, d), path)
    # The schema is given: inferring it would read the files twice.
    return files.read_json_lines(spark, path, schema=f"model STRING, env STRING, {TRACKER_JSON}").select(
        "batch_id", "model", "env", "batch_size", "triggered", "start", "end", "accuracy")


@query("sink_json_lines", tracker_sql() + """
SELECT batch_id, batch_size, triggered, start, "end", accuracy FROM tracker""")
def sink_json_lines(spark, d):
    path = scratch_path(spark, "tracker-sink")
    t = testdata.tracker(spark, d).select("batch_id", "batch_size", "triggered", "start", "end", "accuracy")
    # Written twice: overwrite replaces the first copy, so the read-back equals the table.
    sinks.write_json_lines(t, path)
    sinks.write_json_lines(t, path)
    schema = "batch_id BIGINT, batch_size BIGINT, triggered DOUBLE, start DOUBLE, `end` DOUBLE, accuracy DOUBLE"
    return files.read_json_lines(spark, path, schema=schema)


@query("src_csv_strings", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_retailprice,
       round(p_retailprice / (SELECT max(p_retailprice) FROM part), 9) AS price_norm FROM part""")
def src_csv_strings(spark, d):
    path = scratch_path(spark, "part-csv")
    sinks.write_csv(table(spark, d, "part", "p_partkey", "p_name", "p_retailprice"), path)
    back = files.read_csv_text(spark, path)  # every column is text
    typed = back.select("p_partkey", "p_name", F.col("p_retailprice").cast("double").alias("p_retailprice"))
    return normalise_by_max(typed.withColumn("price_norm", F.col("p_retailprice")), ["price_norm"], 9)


# The columns of a benchmark result file.
INFERENCE_SCHEMA = StructType([
    StructField("model", StringType(), False), StructField("duration", FloatType(), False),
    StructField("total_images", FloatType(), False), StructField("batch_size", FloatType(), False),
    StructField("average_batch_duration", FloatType(), False),
    StructField("balanced_accuracy", FloatType(), False), StructField("env", StringType(), False),
])


@query("src_csv_schema", """
SELECT l_linestatus AS model, CAST(l_quantity AS FLOAT) AS duration, CAST(l_linenumber AS FLOAT) AS batch_size,
       CAST(100.0 - l_discount * 100.0 AS FLOAT) AS balanced_accuracy, l_returnflag AS env FROM lineitem""")
def src_csv_schema(spark, d):
    path = scratch_path(spark, "bench-csv")
    sinks.write_csv(testdata.benchmark_rows(spark, d), path)
    back = files.read_csv_typed(spark, path, INFERENCE_SCHEMA)
    return back.select("model", "duration", "batch_size", "balanced_accuracy", "env")


@query("sink_csv", tracker_sql(12) + """
SELECT model, env, count(*) AS batches, round(avg(latency), 6) AS mean_latency,
       round(avg(throughput), 6) AS mean_throughput FROM metrics WHERE completed GROUP BY model, env""")
def sink_csv(spark, d):
    path = scratch_path(spark, "report-csv")
    rep = reports.stream_report(testdata.tracker(spark, d)).select(
        "model", "env", "batches", "mean_latency", "mean_throughput")
    sinks.write_csv(rep, path)
    schema = "model STRING, env STRING, batches BIGINT, mean_latency DOUBLE, mean_throughput DOUBLE"
    return files.read_csv_typed(spark, path, schema)


@query("src_labelled_text", """
SELECT d.text AS content, l.toxic AS label FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1""")
def src_labelled_text(spark, d):
    path = scratch_path(spark, "text-csv")
    lt = table(spark, d, "documents", "doc_id", "text").join(table(spark, d, "labels"), "doc_id")
    # Low-quality rows carry a junk label (a repeated header), dropped on read.
    raw = lt.select(F.col("text").alias("Content"),
                    F.when(F.col("quality") == 0, F.lit("Label")).otherwise(F.col("toxic").cast("string"))
                    .alias("Label"))
    sinks.write_csv(raw, path, text_safe=True)
    return files.read_labelled_text(spark, path)


@query("src_path_columns", """
SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY event_type""")
def src_path_columns(spark, d):
    path = scratch_path(spark, "events-by-type")
    table(spark, d, "events", "event_id", "event_type", "value").write.partitionBy("event_type").parquet(path)
    back = files.read_with_path_columns(spark, path, "parquet", {"event_type": "event_type=([^/]+)/"})
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("src_labelled_arrays", f"""
SELECT vec_id, label,
       CASE WHEN {bucket_sql('vec_id')} < {TRAIN_PCT} THEN 'data_batch_' || CAST(vec_id % 5 + 1 AS VARCHAR)
            ELSE 'test_batch' END AS part,
       CASE WHEN {bucket_sql('vec_id')} < {TRAIN_PCT} THEN 'train' ELSE 'test' END AS split
FROM embeddings""")
def src_labelled_arrays(spark, d):
    path = scratch_path(spark, "array-parts")
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    part = F.when(md5_bucket("vec_id") < TRAIN_PCT,
                  F.concat(F.lit("data_batch_"), (F.col("vec_id") % 5 + 1).cast("string"))).otherwise(
        F.lit("test_batch"))
    e.withColumn("part", part).write.partitionBy("part").parquet(path)
    back = files.read_with_path_columns(spark, path, "parquet", {"part": "part=([^/]+)/"})
    return back.select("vec_id", "label", "part", F.when(F.col("part") == "test_batch", F.lit("test"))
                       .otherwise(F.lit("train")).alias("split"))


TRACKER_JSON = ("batch_id BIGINT, batch_size BIGINT, triggered DOUBLE, start DOUBLE, `end` DOUBLE, "
                "accuracy DOUBLE")


@query("stream_report_from_files", tracker_sql(12) + """
SELECT model, CASE WHEN env = 'F' THEN 'MAC_CPU' ELSE 'LINUX_GPU' END AS env, count(*) AS batches,
       CAST(sum(batch_size) AS BIGINT) AS images,
       round(avg(latency), 6) AS mean_latency, round(max(latency), 6) AS max_latency,
       round(avg(throughput), 6) AS mean_throughput, round(max(throughput), 6) AS max_throughput,
       count(*) FILTER (WHERE throughput IS NULL) AS zero_spans,
       count(*) FILTER (WHERE clock_skew) AS clock_skews,
       round(avg(accuracy), 6) AS mean_accuracy
FROM metrics WHERE completed GROUP BY 1, 2""")
def stream_report_from_files(spark, d):
    """The reference's stream analysis end to end: tracker JSON lines in one folder
    per run named ``<model>_<env>``, read by one recursive scan with model and env
    parsed from the path, then latency / throughput per (model, env)."""
    path = scratch_path(spark, "trackers")
    t = testdata.tracker(spark, d)
    env_code = F.when(F.col("env") == "F", F.lit("cpu")).otherwise(F.lit("cuda"))
    t.withColumn("run", F.concat_ws("_", "model", env_code)).drop("model", "env") \
        .write.partitionBy("run").json(path)
    back = files.read_with_path_columns(spark, path, "json", {"run": "run=([^/]+)/"}, schema=TRACKER_JSON)
    return reports.stream_report(reports.runs_from_path(back, "run"))
