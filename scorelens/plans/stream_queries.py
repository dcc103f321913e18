"""Streaming queries: micro-batch files, foreachBatch scoring, tracker, replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelens.operators.centroid import train_centroids
from scorelens.plans import testdata
from scorelens.plans.registry import query
from scorelens.plans.scoring_queries import CENTROID_SQL
from scorelens.session import scratch_path
from scorelens.sources.sinks import write_json_array_files
from scorelens.streaming import IMAGE_SCHEMA, produce_micro_batches, run_scoring_stream, tracker_view
from scorelens.streaming.live import run_live
from scorelens.streaming.microbatch import producer_of, push_micro_batches
from scorelens.streaming.progress import trigger_log
from scorelens.streaming.rejects import rejects
from scorelens.streaming.scoring import consumer_of, score_micro_batch, stream_to_table
from scorelens.streaming.source_log import reconcile

# Micro-batch k of the replayed run holds k * 5 rows, whatever the table's size.
STEP = 5
FILES_PER_TRIGGER = 4

BATCHES_SQL = f"""
, r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn, {STEP} AS step FROM embeddings),
b AS (SELECT vec_id, CAST(ceil((sqrt(8.0::DOUBLE * rn / CAST(step AS DOUBLE) + 1.0) - 1.0) / 2.0) AS BIGINT)
             AS batch_id FROM r)
"""

STREAM_SQL = CENTROID_SQL + BATCHES_SQL + """
SELECT b.batch_id, count(*) AS batch_size, count(*) AS scored,
       round(100.0::DOUBLE * sum(CAST(label = pred AS INTEGER)) / count(*), 3) AS accuracy
FROM pred JOIN b USING (vec_id) GROUP BY b.batch_id"""


def _produce(spark, d):
    base = scratch_path(spark, "stream")
    data = testdata.labelled_arrays(spark, d)
    model = train_centroids(data)
    produce_micro_batches(data, f"{base}/input", f"{base}/tracker", [F.col("id")], "increasing", STEP)
    return base, model


@query("sink_micro_batch_files", BATCHES_SQL.replace(", r AS", "WITH r AS", 1) + """
SELECT batch_id, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_files FROM b GROUP BY batch_id""")
def sink_micro_batch_files(spark, d):
    base, _ = _produce(spark, d)
    back = spark.read.schema(IMAGE_SCHEMA).json(f"{base}/input")
    return back.groupBy(F.col("idx").alias("batch_id")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.col("_metadata.file_path")).alias("n_files"))


@query("stream_score_batches", STREAM_SQL)
def stream_score_batches(spark, d):
    base, model = _produce(spark, d)
    run_scoring_stream(spark, f"{base}/input", model, f"{base}/tracker", f"{base}/checkpoint", FILES_PER_TRIGGER)
    return tracker_view(spark, f"{base}/tracker").select("batch_id", "batch_size", "scored", "accuracy")


@query("stream_replay_idempotent", STREAM_SQL)
def stream_replay_idempotent(spark, d):
    """Run the stream, run it again on the same checkpoint (adds nothing), then
    replay one epoch by hand (overwrites its own results): the tracker is unchanged."""
    base, model = _produce(spark, d)
    for _ in range(2):
        run_scoring_stream(spark, f"{base}/input", model, f"{base}/tracker", f"{base}/checkpoint", FILES_PER_TRIGGER)
    epoch0 = spark.read.parquet(f"{base}/tracker/results").filter(F.col("epoch") == 0).select("batch_id").collect()
    if epoch0:  # at most FILES_PER_TRIGGER micro-batches
        replay = spark.read.schema(IMAGE_SCHEMA).json(f"{base}/input").filter(F.col("idx").isin([r[0] for r in epoch0]))
        score_micro_batch(replay, 0, model, f"{base}/tracker", producer=producer_of(f"{base}/input"),
                          consumer=consumer_of(f"{base}/checkpoint"))
    return tracker_view(spark, f"{base}/tracker").select("batch_id", "batch_size", "scored", "accuracy")


@query("src_json_array_stream", BATCHES_SQL.replace(", r AS", "WITH r AS", 1) + """
SELECT e.vec_id AS id, b.batch_id AS idx, e.label, CAST(len(e.embedding) AS INTEGER) AS dims FROM embeddings e JOIN b USING (vec_id)""")
def src_json_array_stream(spark, d):
    """Micro-batch JSON-array files read as a stream, one file per trigger, rows
    appended per epoch (overwrite by epoch id, so a replay cannot duplicate)."""
    base, _ = _produce(spark, d)
    stream_to_table(spark, f"{base}/input", f"{base}/rows", f"{base}/checkpoint", FILES_PER_TRIGGER)
    got = spark.read.parquet(f"{base}/rows")
    return got.select("id", "idx", "label", F.size("data").alias("dims"))


@query("stream_two_producers", CENTROID_SQL + f"""
, h AS (SELECT vec_id, vec_id % 2 AS half, row_number() OVER (PARTITION BY vec_id % 2 ORDER BY vec_id) AS rn FROM embeddings),
b AS (SELECT vec_id, half, CAST(ceil((sqrt(8.0::DOUBLE * rn / {STEP}.0::DOUBLE + 1.0) - 1.0) / 2.0) AS BIGINT) AS batch_id FROM h)
SELECT 'half' || half AS producer, 'centroid' AS model, 'env' || half AS env, b.batch_id, count(*) AS batch_size, count(*) AS scored,
       round(100.0::DOUBLE * sum(CAST(label = pred AS INTEGER)) / count(*), 3) AS accuracy
FROM pred JOIN b USING (vec_id) GROUP BY ALL""")
def stream_two_producers(spark, d):
    """Two producers and two consumers on one tracker: each half of the vectors, both numbering their batches from 1."""
    base = scratch_path(spark, "stream")
    data = testdata.labelled_arrays(spark, d)
    model = train_centroids(data)
    for half in (0, 1):
        own = data.filter(F.pmod("id", F.lit(2)) == half)
        produce_micro_batches(own, f"{base}/input{half}", f"{base}/tracker", [F.col("id")], "increasing", STEP,
                              producer=f"half{half}", model="centroid", env=f"env{half}")
        run_scoring_stream(spark, f"{base}/input{half}", model, f"{base}/tracker", f"{base}/checkpoint{half}",
                           FILES_PER_TRIGGER, producer=f"half{half}")
    return tracker_view(spark, f"{base}/tracker").select("producer", "model", "env", "batch_id", "batch_size", "scored", "accuracy")


# Larger steps where every micro-batch is a trigger of its own.
WIDE_STEP = 20
WIDE_SQL = BATCHES_SQL.replace(f"{STEP} AS step", f"{WIDE_STEP} AS step")


@query("stream_one_file_per_batch", CENTROID_SQL + WIDE_SQL + """
SELECT b.batch_id, count(*) AS batch_size, CAST(1 AS BIGINT) AS triggers, count(*) AS rows_read, true AS within
FROM pred JOIN b USING (vec_id) GROUP BY b.batch_id""")
def stream_one_file_per_batch(spark, d):
    """One file a trigger: the trigger log beside the results, ``within``: scored between the trigger's start and end."""
    base = scratch_path(spark, "stream")
    data = testdata.labelled_arrays(spark, d)
    produce_micro_batches(data, f"{base}/input", f"{base}/tracker", [F.col("id")], "increasing", WIDE_STEP)
    run_scoring_stream(spark, f"{base}/input", train_centroids(data), f"{base}/tracker", f"{base}/checkpoint", log_triggers=True)
    results = spark.read.parquet(f"{base}/tracker/results").select(F.col("epoch").cast("long").alias("epoch"), "batch_id", "n", "start", "end")
    seen = trigger_log(spark, f"{base}/tracker").join(results, "epoch")
    within = (F.col("start") >= F.col("started") - 0.001) & (F.col("end") <= F.col("ended") + 0.001)  # logged in milliseconds
    return seen.groupBy("batch_id").agg(F.sum("n").alias("batch_size"), F.countDistinct("run", "epoch").alias("triggers"),
                                        F.sum("rows").alias("rows_read"), F.min(within).alias("within"))


#: Eight files by vec_id: their rows' idx, and the batch that a row without idx falls back to (the file's place).
IDENTITY_SQL = """
, f AS (SELECT vec_id, vec_id % 8 AS place, CASE vec_id % 8 WHEN 0 THEN 0 WHEN 2 THEN 100 WHEN 3 THEN [0, NULL, 203][vec_id % 3 + 1] WHEN 5 THEN 0 WHEN 7 THEN 100 END AS idx
        FROM embeddings WHERE vec_id % 8 <> 4),
i AS (SELECT vec_id, coalesce(nullif(idx, 0), place) AS batch_id FROM f)
SELECT consumer, CAST(batch_id AS BIGINT) AS batch_id, count(*) AS n, CAST(sum(CAST(label = pred AS INTEGER)) AS BIGINT) AS hits
FROM pred JOIN i USING (vec_id), (SELECT unnest(['c_first', 'c_replay']) AS consumer) GROUP BY ALL"""


@query("stream_batch_identity", CENTROID_SQL + IDENTITY_SQL)
def stream_batch_identity(spark, d):
    """Files whose rows have idx 0, null, a number, all three, or no rows at all; taken three a trigger, then all again
    by a new consumer with a checkpoint of its own and one file a trigger: batches keep their identity."""
    base = scratch_path(spark, "stream")
    data = testdata.labelled_arrays(spark, d)
    place = F.pmod("id", F.lit(8))
    mixed = F.when(F.pmod("id", F.lit(3)) == 0, 0).when(F.pmod("id", F.lit(3)) == 2, 203)
    idx = F.when(place.isin(0, 5), 0).when(place.isin(2, 7), 100).when(place == 3, mixed)
    rows = data.select("id", idx.cast("long").alias("idx"), "data", "label", place.alias("place"))
    for k in range(8):  # one file after the other, as a producer writes them
        if k == 4:
            spark.createDataFrame([("[]",)], "value string").coalesce(1).write.text(f"{base}/input/place=4")
        else:
            write_json_array_files(rows.where(F.col("place") == k), f"{base}/input", "place", order=["id"], mode="append")
    model = train_centroids(data)
    for consumer, n_files in (("first", 3), ("replay", 1)):
        run_scoring_stream(spark, f"{base}/input", model, f"{base}/tracker", f"{base}/checkpoint-{consumer}", n_files, consumer=consumer, identity="file")
    results = spark.read.parquet(f"{base}/tracker/results")
    return results.groupBy("consumer", "batch_id").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


@query("stream_concurrent_tracker", CENTROID_SQL + WIDE_SQL + """
SELECT consumer, b.batch_id, count(*) AS batch_size, count(*) AS scored, round(100.0::DOUBLE * sum(CAST(label = pred AS INTEGER)) / count(*), 3) AS accuracy
FROM pred JOIN b USING (vec_id), (SELECT unnest(['c_a', 'c_b']) AS consumer) GROUP BY ALL""")
def stream_concurrent_tracker(spark, d):
    """A producer that pushes two batches at a time and two consumers, all at once on one tracker: no batch and no row is lost."""
    base = scratch_path(spark, "stream")
    data = testdata.labelled_arrays(spark, d)
    run_live(spark, lambda: push_micro_batches(data, f"{base}/input", f"{base}/tracker", [F.col("id")], "increasing", WIDE_STEP, per_push=2, producer="p"),
             f"{base}/input", train_centroids(data), f"{base}/tracker", {c: f"{base}/checkpoint-{c}" for c in "ab"}, FILES_PER_TRIGGER, producer="p")
    return tracker_view(spark, f"{base}/tracker", by_consumer=True).select("consumer", "batch_id", "batch_size", "scored", "accuracy")


@query("stream_archive_reconcile", CENTROID_SQL + WIDE_SQL + """
SELECT b.batch_id, count(*) AS batch_size, count(*) AS scored, CAST(1 AS BIGINT) AS files, CAST(1 AS BIGINT) AS in_one_place
FROM pred JOIN b USING (vec_id) GROUP BY b.batch_id""")
def stream_archive_reconcile(spark, d):
    """Half the files, a run, the other half, a second run: each consumed file lies in the input or in the archive, and its rows count once."""
    base = scratch_path(spark, "stream")
    data = testdata.labelled_arrays(spark, d)
    model = train_centroids(data)
    produce_micro_batches(data, f"{base}/all", f"{base}/tracker", [F.col("id")], "increasing", WIDE_STEP, producer="p")
    every = spark.read.schema(IMAGE_SCHEMA).json(f"{base}/all")
    for odd in (0, 1):
        half = every.where(F.pmod("idx", F.lit(2)) == odd).withColumn("batch_id", F.col("idx"))
        write_json_array_files(half.select(*IMAGE_SCHEMA.names, "batch_id"), f"{base}/input", "batch_id", order=["id"], mode="append")
        run_scoring_stream(spark, f"{base}/input", model, f"{base}/tracker", f"{base}/checkpoint", archive_dir=f"{base}/archive", producer="p")
    files = reconcile(spark, f"{base}/checkpoint", f"{base}/input", f"{base}/archive")
    per_batch = files.groupBy(F.regexp_extract("file", r"batch_id=(\d+)", 1).cast("long").alias("batch_id")).agg(
        F.count(F.lit(1)).alias("files"), F.count(F.when(F.col("state").isin("input", "archive"), 1)).alias("in_one_place"))
    return tracker_view(spark, f"{base}/tracker").join(per_batch, "batch_id", "full").select("batch_id", "batch_size", "scored", "files", "in_one_place")


#: What a record of the rejects run looks like, by vec_id: whole, or broken in one of six ways.
REJECT_KINDS = {1: "no data", 2: "no label", 3: "broken array", 4: "malformed", 5: "bad data", 6: "malformed"}


@query("stream_rejects", "WITH r AS (SELECT vec_id // 100 AS batch_id, CASE vec_id % 20 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in REJECT_KINDS.items()) + """
 ELSE 'accepted' END AS status FROM embeddings) SELECT batch_id, status, count(*) AS n FROM r GROUP BY ALL""")
def stream_rejects(spark, d):
    """Files with broken records: what is scored and what the dead-letter table holds add up to what was written."""
    base = scratch_path(spark, "stream")
    data = testdata.labelled_arrays(spark, d)
    kind = F.pmod("id", F.lit(20))
    batch = F.floor(F.col("id") / 100)
    record = lambda **change: F.to_json(F.struct(F.col("id"), batch.alias("idx"), *[change.get(c, F.col(c)).alias(c) for c in ("data", "label")]))
    null = F.lit(None)
    text = (F.when(kind == 1, record(data=null.cast("array<float>"))).when(kind == 2, record(label=null.cast("int")))
            .when(kind == 3, F.concat(F.lit("["), F.substring(record(), 1, 40))).when(kind == 4, record(label=F.lit("many")))
            .when(kind == 5, record(data=F.concat("data", F.array(null.cast("float"))))).when(kind == 6, F.lit("42"))
            .otherwise(F.concat(F.lit("["), record(), F.lit("]"))))
    lines = data.select(text.alias("value"), batch.alias("batch_id"))
    lines.repartition("batch_id").write.partitionBy("batch_id").text(f"{base}/input")
    run_scoring_stream(spark, f"{base}/input", train_centroids(data), f"{base}/tracker", f"{base}/checkpoint", FILES_PER_TRIGGER, keep_rejects=True)
    accepted = spark.read.parquet(f"{base}/tracker/results").groupBy("batch_id").agg(F.sum("n").alias("n")).select("batch_id", F.lit("accepted").alias("status"), "n")
    rejected = rejects(spark, f"{base}/tracker").groupBy(F.regexp_extract("file", r"batch_id=(\d+)", 1).cast("long").alias("batch_id"),
                                                        F.col("reason").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return accepted.unionByName(rejected)
