"""How the reference's inputs map onto the driver's test tables.

| reference input         | derived from                                                          |
| ----------------------- | --------------------------------------------------------------------- |
| stream tracker          | orders left join (lineitem aggregated per order)                      |
| class x batch preds     | lineitem: batch = order, class = returnflag, hit = discount > .05     |
| benchmark results       | lineitem: model = linestatus, env = returnflag, ...                   |
| image benchmark results | lineitem: model = one of six names by part key, env by returnflag     |
| trainer runs            | orders: catalog slot = custkey mod 17 (slot 16 is a catalog miss)     |
| trainer logs            | lineitem per order (step = linenumber), sparse by returnflag          |
| trainer-state documents | the logs in order, cut into segments of at most 1,000 entries         |
| labelled text           | documents join labels (label = toxic)                                 |
| labelled arrays         | embeddings (64 values = 4 channels x 16)                              |

Every mapping aggregates before joining, so the join inputs are one row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.functions.times import epoch_seconds
from scorelens.operators.generators import pack_segments
from scorelens.operators.rows import with_row_number
from scorelens.plans import reports
from scorelens.plans.registry import table
from scorelens.sources import dims

# A hit is a line whose discount exceeds this.
HIT_DISCOUNT = 0.05


def tracker_events(spark: SparkSession, d: str) -> DataFrame:
    """Consumer side of the tracker: one result per finished micro-batch (order)."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_shipdate", "l_discount")
    return li.groupBy(F.col("l_orderkey").alias("batch_id")).agg(
        F.sum("l_quantity").cast("bigint").alias("batch_size"),
        epoch_seconds(F.min("l_shipdate")).alias("start"),
        epoch_seconds(F.max("l_shipdate")).alias("end"),
        F.round(F.lit(100.0) * F.avg((F.col("l_discount") > HIT_DISCOUNT).cast("double")), 3).alias("accuracy"),
    )


def tracker_triggers(spark: SparkSession, d: str) -> DataFrame:
    """Producer side: one trigger per micro-batch (order) with its model and env."""
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("batch_id"),
        epoch_seconds("o_orderdate").alias("triggered"),
        F.col("o_orderpriority").alias("model"),
        F.col("o_orderstatus").alias("env"),
    )


def tracker(spark: SparkSession, d: str) -> DataFrame:
    """Tracker view: triggers left join results; unfinished batches keep zeros."""
    t = tracker_triggers(spark, d)
    e = tracker_events(spark, d)
    return t.join(e, "batch_id", "left").select(
        "batch_id", "model", "env",
        F.coalesce("batch_size", F.lit(0).cast("bigint")).alias("batch_size"),
        "triggered",
        F.coalesce("start", F.lit(0.0)).alias("start"),
        F.coalesce("end", F.lit(0.0)).alias("end"),
        F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
    )


def line_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Per-item predictions: batch = order, class = returnflag, seconds = tax."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
               "l_returnflag", "l_discount", "l_tax")
    return li.select(
        F.col("l_orderkey").alias("batch_no"),
        F.col("l_returnflag").alias("class"),
        (F.col("l_discount") > HIT_DISCOUNT).alias("correct"),
        F.col("l_tax").alias("batch_duration"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_discount",
    )


def benchmark_rows(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark result rows (image runs): one per line item."""
    li = table(spark, d, "lineitem", "l_linestatus", "l_returnflag", "l_linenumber",
               "l_quantity", "l_tax", "l_discount", "l_orderkey")
    return li.select(
        F.col("l_linestatus").alias("model"),
        F.col("l_quantity").alias("duration"),
        F.col("l_orderkey").cast("double").alias("total_images"),
        F.col("l_linenumber").cast("double").alias("batch_size"),
        F.col("l_tax").alias("average_batch_duration"),
        (F.lit(100.0) - F.col("l_discount") * F.lit(100.0)).alias("balanced_accuracy"),
        F.col("l_returnflag").alias("env"),
    )


def labelled_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    labels = table(spark, d, "labels", "doc_id", "toxic")
    return docs.join(labels, "doc_id").select("doc_id", F.col("text").alias("content"),
                                              F.col("toxic").alias("label"))


def labelled_arrays(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("data"), "label")


# Run -> catalog position: o_custkey mod this; position 16 has no catalog row,
# so some runs exercise the "model missing from the catalog" path.
CATALOG_SLOTS = 17
# Run environment from the order status ('F' has no env part -> GPU).
RUN_ENV = {"O": "COLAB_GPU", "P": "COLAB_GPU"}
DEFAULT_ENV = "GPU"


def trainer_runs(spark: SparkSession, d: str) -> DataFrame:
    """One trainer-state header per run (order): model name, catalog slot, env, sizes.

    The model is the catalog's name at the run's slot; the extra slot has no
    name (a model missing from the catalog).
    """
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    env = F.coalesce(*[F.when(F.col("o_orderstatus") == k, F.lit(v)) for k, v in RUN_ENV.items()],
                     F.lit(DEFAULT_ENV))
    slot = (F.col("o_custkey") % CATALOG_SLOTS).cast("int")
    names = F.array(*[F.lit(m) for m, _, _ in dims.CATALOG])
    return o.select(
        F.col("o_orderkey").alias("run_id"),
        F.try_element_at(names, slot + 1).alias("model"),
        slot.alias("position"),
        env.alias("env"),
        F.col("o_totalprice").alias("total_flos"),
        (F.col("o_custkey") % 4 * 8 + 8).cast("int").alias("train_batch_size"),
        (F.col("o_orderkey") % 1000).cast("int").alias("global_step"),
    )


def trainer_log_entries(spark: SparkSession, d: str) -> DataFrame:
    """Exploded log history: step = line number; 'R' lines are training summaries,
    the others evaluations (sparse columns are null, as in trainer logs)."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
               "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return li.select(F.col("l_orderkey").alias("run_id"), "l_partkey", "l_suppkey", *log_fields())


def log_fields(line: Column | None = None) -> list:
    """The fifteen fields of a log entry, from a line item (the columns at hand, or a struct of them)."""
    of = F.col if line is None else line.getField
    train = of("l_returnflag") == "R"
    ev = ~train
    return [
        of("l_tax").alias("loss"),
        of("l_linenumber").cast("double").alias("step"),
        F.when(ev, of("l_tax")).alias("eval_loss"),
        F.when(ev, F.lit(1.0) - of("l_tax")).alias("eval_accuracy"),
        F.when(ev, F.lit(1.0) - of("l_discount")).alias("eval_f1"),
        F.when(ev, F.lit(1.0) - of("l_discount") * 0.5).alias("eval_precision"),
        F.when(ev, F.lit(1.0) - of("l_tax") * 0.5).alias("eval_recall"),
        F.when(ev, of("l_quantity")).alias("eval_runtime"),
        F.when(ev, of("l_extendedprice")).alias("eval_samples_per_second"),
        F.when(ev, of("l_discount")).alias("eval_steps_per_second"),
        F.when(train, of("l_extendedprice") * 2.0).alias("total_flos"),
        F.when(train, of("l_tax") * 0.5).alias("train_loss"),
        F.when(train, of("l_quantity")).alias("train_runtime"),
        F.when(train, of("l_extendedprice")).alias("train_samples_per_second"),
        F.when(train, of("l_discount")).alias("train_steps_per_second"),
    ]


#: The same fields in SQL, for the oracles.
LOG_FIELDS_SQL = """
l_tax AS loss, CAST(l_linenumber AS DOUBLE) AS step, CASE WHEN l_returnflag <> 'R' THEN l_tax END AS eval_loss,
CASE WHEN l_returnflag <> 'R' THEN 1.0 - l_tax END AS eval_accuracy,
CASE WHEN l_returnflag <> 'R' THEN 1.0 - l_discount END AS eval_f1,
CASE WHEN l_returnflag <> 'R' THEN 1.0 - l_discount * 0.5 END AS eval_precision,
CASE WHEN l_returnflag <> 'R' THEN 1.0 - l_tax * 0.5 END AS eval_recall,
CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS eval_runtime,
CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS eval_samples_per_second,
CASE WHEN l_returnflag <> 'R' THEN l_discount END AS eval_steps_per_second,
CASE WHEN l_returnflag = 'R' THEN l_extendedprice * 2.0 END AS total_flos,
CASE WHEN l_returnflag = 'R' THEN l_tax * 0.5 END AS train_loss,
CASE WHEN l_returnflag = 'R' THEN l_quantity END AS train_runtime,
CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS train_samples_per_second,
CASE WHEN l_returnflag = 'R' THEN l_discount END AS train_steps_per_second"""


# The six image models and three environments of the benchmark files.
BENCH_MODELS = [
    "aaraki/vit-base-patch16-224-in21k-finetuned-cifar10",
    "tzhao3/DeiT-CIFAR10",
    "ahsanjavid/convnext-tiny-finetuned-cifar10",
    "facebook/deit-tiny-patch16-224",
    "facebook/deit-tiny-distilled-patch16-224",
    "facebook/convnextv2-tiny-22k-224",
]
BENCH_ENVS = {"A": "cpu", "N": "mac_cpu", "R": "cuda"}


def inference_results(spark: SparkSession, d: str, keyed: bool = False) -> DataFrame:
    """Image benchmark result rows with real model names (model by part key); ``keyed`` adds the row's key."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_returnflag", "l_linenumber", "l_quantity", "l_tax",
               "l_discount")
    names = F.array(*[F.lit(m) for m in BENCH_MODELS])
    env = F.coalesce(*[F.when(F.col("l_returnflag") == k, F.lit(v)) for k, v in BENCH_ENVS.items()])
    return li.select(
        F.element_at(names, (F.col("l_partkey") % len(BENCH_MODELS) + 1).cast("int")).alias("model"),
        F.col("l_quantity").alias("duration"),
        (F.col("l_quantity") * F.lit(10.0)).alias("total_images"),
        F.col("l_linenumber").cast("double").alias("batch_size"),
        F.col("l_tax").alias("average_batch_duration"),
        (F.lit(100.0) - F.col("l_discount") * F.lit(100.0)).alias("balanced_accuracy"),
        env.alias("env"),
        *([F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("row_key")] if keyed else []),
    )


# Largest number of log entries in one trainer-state document (longer runs are
# split into consecutive segments, each with its offset in the run).
LOG_SEGMENT = 1_000


def trainer_states(spark: SparkSession, d: str, segment: int = LOG_SEGMENT) -> DataFrame:
    """Trainer-state documents: (run_id, segment, offset, total_flos, train_batch_size, global_step, log_history).

    Entries are ordered by step and then by the line's values (a total order, so
    positions are reproducible) and numbered globally without a per-run window;
    a run's history is cut into segments of at most ``segment`` entries, so no
    document or group grows with a hot run.
    """

    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
               "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag"]
    # Lines travel as they are read; an entry's fields are made when its document is there.
    numbered = with_row_number(li.select(*order), [F.col(c) for c in order])
    docs = pack_segments(numbered.withColumnRenamed("l_orderkey", "run_id"), "run_id", "rn", F.struct(*order[1:]), segment, "lines")
    docs = docs.select("run_id", "segment", "offset", F.transform("lines", lambda line: F.struct(*log_fields(line))).alias("log_history"))
    runs = trainer_runs(spark, d).select("run_id", "total_flos", "train_batch_size", "global_step")
    return runs.join(docs, "run_id")


# The line table has no log position; its keys give the total order instead.
LOG_ORDER = ("step", "l_partkey", "l_suppkey")


def training_report(spark: SparkSession, d: str) -> DataFrame:
    """The training report over the test tables' runs, logs and the catalog."""
    return reports.training_report(trainer_runs(spark, d), trainer_log_entries(spark, d), dims.catalog(spark),
                                   order=LOG_ORDER)
