"""Softmax regression trained in full-batch epochs, with the model and a trainer-log row stored after each.

An epoch is one pass over the training rows: every row's class probabilities are array expressions against the
current weights (a scalar subquery: classes x (dimensions + 1) values, size checked), and the gradient is the
sum of (probability - truth) x input over all rows, summed per input position by partial and final aggregates. So a class that
holds a third of the rows is reduced in each task, and the driver gets as many numbers as the model has.

``path/epoch=<k>/model`` holds the weights after epoch k, ``path/epoch=<k>/log`` its log row, written last: a run that is
started again goes on after the last epoch whose log is complete and does the one after it anew. The result does not depend on how often
it was interrupted. Log rows have the fields of a trainer log, so the reports read them; the best epoch is a ``max_by`` over them.

Rows without data or label, or whose data has another length than the model, take no part. An evaluation label that training has
not seen counts as a miss and has no loss.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.operators.centroid import SCORE_DIGITS, settled
from scorelens.operators.metrics import weighted_from_confusion

MAX_VALUES = 1_000_000  # classes x (dimensions + 1): the driver holds a few times as many numbers
MODEL = "labels array<int>, weights array<array<double>>"
LOG = ("step double, loss double, eval_loss double, eval_accuracy double, eval_f1 double, eval_precision double, eval_recall double, "
       "eval_runtime double, eval_samples_per_second double, eval_steps_per_second double, train_rows long, seconds double")


def train_epochs(train: DataFrame, evaluation: DataFrame, path: str, epochs: int, rate: float, vec: str = "data", label: str = "label") -> DataFrame:
    """Train up to ``epochs`` epochs in all under ``path`` and return the log rows, one an epoch."""
    spark = train.sparkSession
    rows, held_out = (df.where(F.col(vec).isNotNull() & F.col(label).isNotNull()).select(F.col(vec).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"))
                      for df in (train, evaluation))
    done = last_epoch(spark, path, epochs)
    if not done:
        labels = [r["y"] for r in rows.select("y").distinct().orderBy("y").limit(MAX_VALUES).collect()]
        first = rows.select(F.size("x").alias("n")).limit(1).collect()
        if not labels:
            raise ValueError("no rows to train on")
        model = (labels, [[0.0] * (first[0]["n"] + 1) for _ in labels])
    else:
        model = _stored_model(spark, path, done)
    if len(model[0]) * len(model[1][0]) > MAX_VALUES:
        raise ValueError(f"a model of {len(model[0])} x {len(model[1][0])} values is too large")
    rows, held_out = (df.where(F.size("x") == len(model[1][0]) - 1) for df in (rows, held_out))
    for epoch in range(done + 1, epochs + 1):
        began = time.time()
        gradient, loss, n = _gradient(rows, _table(spark, model), len(model[0]))
        model = (model[0], [[w - rate * g for w, g in zip(ws, gs, strict=True)] for ws, gs in zip(model[1], gradient, strict=True)])
        took = time.time() - began
        spark.createDataFrame([model], MODEL).write.mode("overwrite").parquet(f"{path}/epoch={epoch}/model")
        _evaluated(held_out, _table(spark, model), epoch, loss, n, took).coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={epoch}/log")
    return read_log(spark, path, epochs)


def read_log(spark: SparkSession, path: str, epochs: int) -> DataFrame:
    return spark.read.schema(LOG).parquet(*[f"{path}/epoch={k}/log" for k in range(1, epochs + 1)])


def last_epoch(spark: SparkSession, path: str, epochs: int) -> int:
    """The last of the first ``epochs`` epochs whose log is complete; 0 if none is."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for k in range(1, epochs + 1):
        if not fs.exists(hadoop.Path(f"{path}/epoch={k}/log/_SUCCESS")):
            return k - 1
    return epochs


def best_epoch(log: DataFrame) -> DataFrame:
    """The log row with the best accuracy, then the smallest loss, then the earliest step."""
    order = F.struct("eval_accuracy", (-F.col("eval_loss")).alias("l"), (-F.col("step")).alias("s"))
    return log.agg(F.max_by(F.struct(*[F.col(c) for c in log.columns]), order).alias("best")).where("best is not null").select("best.*")


def best_model(spark: SparkSession, path: str, log: DataFrame) -> DataFrame:
    """The stored model of the best epoch (labels, weights)."""
    return spark.read.schema(MODEL).parquet(f"{path}/epoch={int(best_epoch(log).first()['step'])}/model")


def trainer_entries(log: DataFrame, run_id: Column) -> DataFrame:
    """Log rows as a trainer-log history of one run: an entry an epoch, and a summary of the training at the end."""
    fields = [c.split()[0] for c in LOG.split(", ")[:10]]
    summary = log.agg(F.max("step").alias("step"), F.sum("seconds").alias("train_runtime"), F.avg("loss").alias("train_loss"),
                      F.try_divide(F.sum("train_rows"), F.sum("seconds")).alias("train_samples_per_second"),
                      F.try_divide(F.count(F.lit(1)), F.sum("seconds")).alias("train_steps_per_second"))
    entries = log.select(*fields).unionByName(summary, allowMissingColumns=True)
    return entries.select(run_id.alias("run_id"), F.when(F.col("train_runtime").isNull(), F.col("step") - 1).otherwise(F.col("step")).cast("int").alias("pos"), "*")


def probabilities(df: DataFrame, model: DataFrame, vec: str = "x") -> DataFrame:
    """Add ``_z`` (scores by class) and ``_norm`` (log of the sum of their exponentials), both against the model."""
    with_model = df.withColumn("_w", model.select("weights").scalar()).withColumn("_labels", model.select("labels").scalar())
    dot = lambda w: F.aggregate(F.zip_with(F.concat(F.col(vec), F.array(F.lit(1.0))), w, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    scored = with_model.withColumn("_z", F.transform("_w", dot)).drop("_w").withColumn("_top", F.array_max("_z"))
    return scored.withColumn("_norm", F.col("_top") + F.log(F.aggregate("_z", F.lit(0.0), lambda s, z: s + F.exp(z - F.col("_top"))))).drop("_top")


def predict(df: DataFrame, model: DataFrame, vec: str = "data") -> DataFrame:
    """Add ``pred``: the likeliest class (scores to 9 digits; ties: the smallest label)."""
    scored = probabilities(df.withColumn("_x", F.col(vec).cast("array<double>")), model, "_x")
    return scored.withColumn("pred", _likeliest()).drop("_x", "_z", "_norm", "_labels")


def _likeliest() -> Column:
    pairs = F.zip_with("_z", "_labels", lambda z, y: F.struct(F.round(z, SCORE_DIGITS).alias("z"), (-y).alias("neg")))
    return (-F.array_max(pairs)["neg"]).cast("int")


def _loss() -> Column:
    at = F.array_position("_labels", F.col("y"))
    return F.when(at > 0, F.col("_norm") - F.try_element_at("_z", at.cast("int")))


def _gradient(rows: DataFrame, model: DataFrame, classes: int) -> tuple[list[list[float]], float, int]:
    """Mean gradient (classes x positions), mean loss before the step, number of rows: one pass."""
    scored = probabilities(rows, model)
    wrong = F.zip_with("_z", "_labels", lambda z, y: F.exp(z - F.col("_norm")) - (y == F.col("y")).cast("double"))
    each = scored.select(F.concat("x", F.array(F.lit(1.0))).alias("x"), wrong.alias("g"), _loss().alias("loss"), F.size("x").alias("bias"))
    each = each.select("bias", *[F.get("g", c).alias(f"g{c}") for c in range(classes)], "loss", F.posexplode("x").alias("pos", "v"))
    last = F.col("pos") == F.col("bias")
    sums = each.groupBy("pos").agg(*[F.sum(F.col(f"g{c}") * F.col("v")).alias(f"g{c}") for c in range(classes)],
                                   F.sum(F.when(last, F.col("loss"))).alias("loss"), F.count(F.when(last, 1)).alias("n")).orderBy("pos").collect()
    n = sums[-1]["n"]
    return [[r[f"g{c}"] / n for r in sums] for c in range(classes)], sums[-1]["loss"] / n, n


def _evaluated(rows: DataFrame, model: DataFrame, epoch: int, loss: float, n: int, took: float) -> DataFrame:
    """The epoch's log row: one pass over the evaluation rows gives the confusion table with its losses."""
    began = time.time()
    scored = probabilities(rows, model).select("y", _likeliest().alias("pred"), _loss().alias("loss"))
    cells = settled(scored.groupBy(F.col("y").alias("label"), "pred").agg(F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss"), F.count("loss").alias("known")))
    seconds = time.time() - began
    totals = cells.agg(F.try_divide(F.sum("loss"), F.sum("known")).alias("eval_loss"), F.sum("n").alias("rows"),
                       F.try_divide(F.sum(F.when(F.col("label") == F.col("pred"), F.col("n"))).cast("double"), F.sum("n")).alias("eval_accuracy"))
    weighted = weighted_from_confusion(cells, digits=12).first()  # one row
    metric = lambda name: F.lit(weighted[name]).cast("double").alias(f"eval_{name}")
    return totals.select(F.lit(float(epoch)).alias("step"), F.lit(loss).cast("double").alias("loss"), "eval_loss", F.coalesce("eval_accuracy", F.when(F.col("rows") > 0, 0.0)).alias("eval_accuracy"),
                         metric("f1"), metric("precision"), metric("recall"), F.lit(seconds).alias("eval_runtime"),
                         (F.col("rows") / F.lit(seconds)).alias("eval_samples_per_second"), F.lit(1.0 / seconds).alias("eval_steps_per_second"),
                         F.lit(n).cast("long").alias("train_rows"), F.lit(took).alias("seconds"))


def _table(spark: SparkSession, model: tuple[list[int], list[list[float]]]) -> DataFrame:
    return spark.createDataFrame([model], MODEL)


def _stored_model(spark: SparkSession, path: str, epoch: int) -> tuple[list[int], list[list[float]]]:
    row = spark.read.schema(MODEL).parquet(f"{path}/epoch={epoch}/model").first()
    return list(row["labels"]), [list(w) for w in row["weights"]]
