"""Report workflows over evaluation logs (stream tracker, benchmarks, trainer logs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.functions.text import with_unit
from scorelens.operators.bootstrap import bootstrap_band
from scorelens.operators.joins import lookup
from scorelens.operators.latest import latest_struct
from scorelens.operators.metrics import consistency_rows, consistency_verdict, mean_by, mean_with_band
from scorelens.operators.relabel import normalise_by_max, relabel, unpivot

# Chart names of environments and models (benchmark side).
ENV_NAMES = {"cpu": "LINUX_CPU", "mac_cpu": "MAC_CPU", "cuda": "LINUX_CUDA"}
TRAIN_ENV_NAMES = {"COLAB_GPU": "LINUX_GPU", "GPU": "MAC_GPU"}


def stream_metrics(tracker: DataFrame, digits: int = 9) -> DataFrame:
    """Per micro-batch: signed latency (start - triggered), throughput, flags.

    Unfinished rows (end = 0) get null latency and throughput; a zero span gives
    null throughput (``try_divide``), never a division error; negative latency is
    kept and flagged as clock skew, not clamped.
    """
    done = F.col("end") > F.lit(0.0)
    latency = F.when(done, F.col("start") - F.col("triggered"))
    span = F.col("end") - F.col("start")
    throughput = F.when(done, F.try_divide(F.col("batch_size").cast("double"), span))
    return tracker.select(
        "*",
        done.alias("completed"),
        F.round(latency, digits).alias("latency"),
        F.round(throughput, digits).alias("throughput"),
        (latency < F.lit(0.0)).alias("clock_skew"),
    )


def runs_from_path(df: DataFrame, run: str = "run") -> DataFrame:
    """Model and environment from a ``<model>_<env>`` folder name; ``cpu`` is the
    Mac CPU run, anything else a Linux GPU run."""
    parts = F.split(F.url_decode(F.col(run)), "_")
    env = F.when(F.element_at(parts, 2) == F.lit("cpu"), F.lit("MAC_CPU")).otherwise(F.lit("LINUX_GPU"))
    return df.withColumn("model", F.element_at(parts, 1)).withColumn("env", env).drop(run)


def stream_report(tracker: DataFrame, digits: int = 6) -> DataFrame:
    """Latency and throughput summary per (model, env) over completed batches."""
    m = stream_metrics(tracker, digits=12).filter(F.col("completed"))
    return (
        m.groupBy("model", "env")
        .agg(
            F.count(F.lit(1)).alias("batches"),
            F.sum("batch_size").alias("images"),
            F.round(F.avg("latency"), digits).alias("mean_latency"),
            F.round(F.max("latency"), digits).alias("max_latency"),
            F.round(F.avg("throughput"), digits).alias("mean_throughput"),
            F.round(F.max("throughput"), digits).alias("max_throughput"),
            F.count(F.when(F.col("throughput").isNull(), 1)).alias("zero_spans"),
            F.count(F.when(F.col("clock_skew"), 1)).alias("clock_skews"),
            F.round(F.avg("accuracy"), digits).alias("mean_accuracy"),
        )
        .orderBy("model", "env")
    )


def stream_line_chart(tracker: DataFrame, y: str, digits: int = 6) -> DataFrame:
    """Chart-ready line: mean of ``y`` per (images, model, env) with a 95 % band."""
    m = stream_metrics(tracker, digits=12).filter(F.col("completed"))
    return mean_with_band(m.withColumnRenamed("batch_size", "images"), ["images", "model", "env"], y, digits)


def stream_line_bootstrap(tracker: DataFrame, replicates: int = 1000, row: str = "batch_id", level: float = 0.95) -> DataFrame:
    """Both line charts of a stream run with bootstrap bands, from one pass: mean latency and throughput per (images, model, env)."""
    m = stream_metrics(tracker, digits=12).filter(F.col("completed")).withColumnRenamed("batch_size", "images")
    return bootstrap_band(m, ["images", "model", "env"], ["latency", "throughput"], F.col(row), replicates, level,
                          digits={"latency": 3, "throughput": 9})


def relabel_env(col: str = "env") -> F.Column:
    return relabel(col, ENV_NAMES)


def trainer_runs_from_paths(states: DataFrame, path: str = "path") -> DataFrame:
    """Run headers from trainer-state file paths ``.../<group>/<model>[:<env>]/<dir>/<file>``:
    run id = the path, model = ``<group>/<model>``, env after ``:`` or ``GPU``."""
    parts = F.split(F.url_decode(F.col(path)), "/")
    name = F.element_at(parts, -3)
    model = F.concat_ws("/", F.element_at(parts, -4), F.substring_index(name, ":", 1))
    env = F.when(name.contains(":"), F.substring_index(name, ":", -1)).otherwise(F.lit("GPU"))
    return states.select(F.col(path).alias("run_id"), model.alias("model"), env.alias("env"),
                         "total_flos", *[c for c in RUN_FACTS if c in states.columns])


# A run's settings, and the fields of its log that a report shows.
RUN_FACTS = ["train_batch_size", "global_step"]
TRAIN_FIELDS = ["train_runtime", "train_samples_per_second", "train_steps_per_second"]
EVAL_FIELDS = ["eval_accuracy", "eval_f1", "eval_loss", "eval_precision", "eval_recall", "eval_runtime",
               "eval_samples_per_second", "eval_steps_per_second"]


def training_report(runs: DataFrame, entries: DataFrame, catalog: DataFrame,
                    order: tuple[str, ...] = ("step", "pos")) -> DataFrame:
    """One row per run: catalog facts, final training summary, latest evaluation.

    Runs (run_id, model, env, total_flos and RUN_FACTS if given) are keyed by run id (the file), not by
    model name, so a model trained in two environments gives two rows; the
    catalog is looked up by model name (a miss is flagged, not an error). The log is read once: one aggregation per
    run keeps both the latest training summary and the latest evaluation
    (largest step, line keys and values as tie-break) as conditional struct
    maxima, combined map-side (skew-safe). ``order`` is the total order that
    decides "latest": step, then position in the log (a later entry wins).
    """
    ties = list(order)
    train_cols = TRAIN_FIELDS
    eval_cols = [c for c in EVAL_FIELDS if c in entries.columns]
    latest = entries.groupBy("run_id").agg(
        latest_struct(ties + train_cols, train_cols, F.col("train_runtime").isNotNull()).alias("_t"),
        latest_struct(ties + eval_cols, ["step"] + eval_cols, F.col("eval_accuracy").isNotNull()).alias("_e"),
    ).filter(F.col("_t").isNotNull() & F.col("_e").isNotNull()).select(
        "run_id", *[F.col(f"_t.{c}").alias(c) for c in train_cols], F.col("_e.step").alias("eval_step"),
        *[F.col(f"_e.{c}").alias(c) for c in eval_cols])
    facts = catalog.select("model", "params", "size")
    head = lookup(runs, facts, "model", flag="missing_model", max_rows=10_000).select(
        "run_id", "model", "env",
        with_unit("params", "M").alias("params"), with_unit("size", "MB").alias("size"),
        *[c for c in RUN_FACTS if c in runs.columns], "total_flos", "missing_model",
    )
    return head.join(latest, "run_id")


# Chart names of trained models, and of benchmarked image models.
TRAIN_MODEL_NAMES = {
    "google/vit-base-patch16-224": "ViT",
    "facebook/deit-tiny-patch16-224": "DeiT",
    "facebook/convnext-small-224": "ConvNext",
    "facebook/convnextv2-nano-22k-224": "ConvNextV2",
}
IMAGE_MODEL_NAMES = {
    "aaraki/vit-base-patch16-224-in21k-finetuned-cifar10": "ViT",
    "tzhao3/DeiT-CIFAR10": "DeiT",
    "ahsanjavid/convnext-tiny-finetuned-cifar10": "ConvNext",
    "facebook/convnextv2-tiny-22k-224": "ConvNextV2",
}
TRAIN_METRICS = {"total_flos": "flos", "train_runtime": "runtime",
                 "train_samples_per_second": "batch_per_second", "train_steps_per_second": "step_per_second"}


def training_chart(report: DataFrame, digits: int = 9) -> DataFrame:
    """Bar heights per (env panel, metric, model): relabel, keep charted models,
    normalise each metric by its maximum, unpivot, average."""
    r = report.select(
        relabel("model", TRAIN_MODEL_NAMES).alias("model"), relabel("env", TRAIN_ENV_NAMES).alias("env"),
        *[F.col(c).cast("double").alias(c) for c in TRAIN_METRICS],
    ).filter(F.col("model").isin(list(TRAIN_MODEL_NAMES.values())))
    n = normalise_by_max(r, list(TRAIN_METRICS))
    n = n.select("model", "env", *[F.col(c).alias(a) for c, a in TRAIN_METRICS.items()])
    return mean_by(unpivot(n, ["model", "env"]), ["env", "category", "model"], "normalized_value", "mean", digits)


def batch_size_chart(results: DataFrame, digits: int = 9) -> DataFrame:
    """Average batch duration by batch size, per model and environment (line + band)."""
    r = results.select(
        relabel("model", IMAGE_MODEL_NAMES).alias("model"), relabel_env("env").alias("env"),
        "batch_size", "average_batch_duration",
    ).filter(F.col("model").isin(list(IMAGE_MODEL_NAMES.values())))
    return mean_with_band(r, ["batch_size", "model", "env"], "average_batch_duration", digits)


def batch_size_bootstrap(results: DataFrame, replicates: int = 1000, row: str = "row_key", digits: int = 9) -> DataFrame:
    """The same line with a bootstrap band; ``row`` names a result row."""
    r = results.select(relabel("model", IMAGE_MODEL_NAMES).alias("model"), relabel_env("env").alias("env"), "batch_size", "average_batch_duration", row
                       ).filter(F.col("model").isin(list(IMAGE_MODEL_NAMES.values())))
    return bootstrap_band(r, ["batch_size", "model", "env"], ["average_batch_duration"], F.col(row), replicates, digits=digits)


def test_size_chart(results: DataFrame, digits: int = 9) -> DataFrame:
    """Run duration by test size per environment (line + band)."""
    r = results.select(F.col("duration"), F.col("total_images").alias("test_size"), relabel_env("env").alias("env"))
    return mean_with_band(r, ["test_size", "env"], "duration", digits)


def consistency_check(results: DataFrame, key: str = "model", env: str = "env",
                      value: str = "balanced_accuracy", digits: int = 3) -> DataFrame:
    """Distinct (key, environment, rounded accuracy) rows with the key's verdict:
    consistent when every environment and run gave the same rounded value."""
    detail = consistency_rows(results, key, env, value, digits)
    verdict = consistency_verdict(results, key, value, digits).select(key, "consistent")
    return detail.join(verdict, key)
