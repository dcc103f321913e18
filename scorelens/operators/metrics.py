"""Prediction metrics as grouped aggregates (partial + final, one shuffle each).

Inputs are prediction rows: a label, a prediction and/or a correct flag, a
class, a batch number and a batch duration in seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hit(correct: str) -> Column:
    return F.col(correct).cast("double")


def class_accuracy(df: DataFrame, cls: str = "class", correct: str = "correct",
                   duration: str | None = "batch_duration") -> DataFrame:
    """Per class: 100 * hits / rows, and the row-weighted mean batch duration."""
    aggs = [F.count(F.lit(1)).alias("n"), (F.lit(100.0) * F.avg(_hit(correct))).alias("accuracy")]
    if duration:
        aggs.append(F.avg(F.col(duration).cast("double")).alias("avg_batch_duration"))
    return df.groupBy(cls).agg(*aggs)


def balanced_accuracy(per_class: DataFrame, digits: int = 3) -> DataFrame:
    """Mean of the class accuracies (present classes only), rounded."""
    return per_class.agg(F.round(F.avg("accuracy"), digits).alias("balanced_accuracy"))


def class_mean_batch_duration(per_class: DataFrame, digits: int = 5) -> DataFrame:
    """Mean over classes of each class's mean batch duration (image runs)."""
    return per_class.agg(F.round(F.avg("avg_batch_duration"), digits).alias("average_batch_duration"))


def micro_batch_accuracy(df: DataFrame, batch: str = "batch_id", correct: str = "correct",
                         digits: int = 3) -> DataFrame:
    return df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("batch_size"),
        F.round(F.lit(100.0) * F.avg(_hit(correct)), digits).alias("accuracy"),
    )


def overall_accuracy(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Row-weighted accuracy as a fraction."""
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def mean_of_batch_means(df: DataFrame, batch: str = "batch_no", correct: str = "correct") -> DataFrame:
    """Unweighted mean of per-batch hit rates: a short last batch counts fully."""
    per_batch = df.groupBy(batch).agg(F.avg(_hit(correct)).alias("_m"))
    return per_batch.agg(F.avg("_m").alias("accuracy"), F.count(F.lit(1)).alias("n_batches"))


def wall_time_per_batch(df: DataFrame, batch: str = "batch_no",
                        duration: str = "batch_duration") -> DataFrame:
    """Total time over the number of batches; a batch's time is its largest row value."""
    per_batch = df.groupBy(batch).agg(F.max(F.col(duration).cast("double")).alias("_d"))
    return per_batch.agg(
        F.sum("_d").alias("duration"),
        F.count(F.lit(1)).alias("n_batches"),
        (F.sum("_d") / F.count(F.lit(1))).alias("average_batch_duration"),
    )


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))


def _ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where undefined (no predicted or no true positives)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return _ratio(F.lit(2.0) * p * r, p + r)


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "pred",
                   positive=1, digits: int = 9) -> DataFrame:
    """Accuracy, precision, recall, F1 of the positive class."""
    y, p = F.col(label) == F.lit(positive), F.col(pred) == F.lit(positive)
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col(label) == F.col(pred)).cast("int")).alias("hits"),
        F.sum((y & p).cast("int")).alias("tp"),
        F.sum((~y & p).cast("int")).alias("fp"),
        F.sum((y & ~p).cast("int")).alias("fn"),
    )
    prec = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(
        F.col("tp").cast("bigint").alias("tp"), F.col("fp").cast("bigint").alias("fp"),
        F.col("fn").cast("bigint").alias("fn"),
        F.round(_ratio(F.col("hits"), F.col("n")), digits).alias("accuracy"),
        F.round(prec, digits).alias("precision"), F.round(rec, digits).alias("recall"),
        F.round(_f1(prec, rec), digits).alias("f1"),
    )


def per_class_metrics(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Per class: support n, true positives, times predicted, precision, recall, F1.

    One pass: the confusion table (at most classes x classes rows after a
    map-side combined aggregate) gives every cell twice, once for its true class
    and once for its predicted class, and one more aggregate sums them. No join,
    so the predictions are computed once. Classes never seen as a label (support
    0) are dropped, as a support-weighted average ignores them.
    """
    return per_class_from_confusion(confusion_counts(df, label, pred), label, pred)


def per_class_from_confusion(conf: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """The same from a confusion table (label, pred, n)."""
    hit = F.col(label) == F.col(pred)
    cells = conf.select(F.explode(F.array(
        F.struct(F.col(label).alias("cls"), F.col("n").alias("support"),
                 F.when(hit, F.col("n")).otherwise(F.lit(0)).alias("tp"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col(pred).alias("cls"), F.lit(0).cast("bigint").alias("support"),
                 F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("predicted")),
    )).alias("c")).select("c.*")
    m = cells.groupBy("cls").agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"),
                                 F.sum("predicted").alias("predicted")).filter(F.col("support") > 0)
    prec = _ratio(F.col("tp"), F.col("predicted"))
    rec = _ratio(F.col("tp"), F.col("support"))
    return m.select("cls", "support", "tp", "predicted", prec.alias("precision"),
                    rec.alias("recall"), _f1(prec, rec).alias("f1"))


def weighted_metrics(df: DataFrame, label: str = "label", pred: str = "pred",
                     digits: int = 6) -> DataFrame:
    """Support-weighted precision, recall and F1 (classes with support only)."""
    return weighted_from_confusion(confusion_counts(df, label, pred), label, pred, digits)


def weighted_from_confusion(conf: DataFrame, label: str = "label", pred: str = "pred", digits: int = 6) -> DataFrame:
    """The same from a confusion table (label, pred, n)."""
    pc = per_class_from_confusion(conf, label, pred)
    w = F.col("support").cast("double")
    return pc.agg(
        F.round(F.sum(w * F.col("precision")) / F.sum(w), digits).alias("precision"),
        F.round(F.sum(w * F.col("recall")) / F.sum(w), digits).alias("recall"),
        F.round(F.sum(w * F.col("f1")) / F.sum(w), digits).alias("f1"),
    )


def consistency_rows(df: DataFrame, key: str, env: str, value: str, digits: int = 3,
                     key_name: str | None = None) -> DataFrame:
    """Distinct (key, environment, rounded value): the consistency detail table."""
    return df.select(
        F.col(key).alias(key_name or key), F.col(env).alias("environment"),
        F.round(F.col(value).cast("double"), digits).alias("accuracy"),
    ).distinct()


def consistency_sets(df: DataFrame, key: str, env: str, value: str, digits: int = 3,
                     key_name: str | None = None) -> DataFrame:
    """Per key the set of (environment, rounded value), exploded back to rows.

    ``collect_set`` is combined map-side (each task keeps distinct pairs only).
    """
    pair = F.struct(F.col(env).alias("environment"),
                    F.round(F.col(value).cast("double"), digits).alias("accuracy"))
    sets = df.groupBy(F.col(key).alias(key_name or key)).agg(F.array_sort(F.collect_set(pair)).alias("detail"))
    return sets.select(key_name or key, F.inline("detail"))


def consistency_verdict(df: DataFrame, key: str, value: str, digits: int = 3) -> DataFrame:
    """Per key: true when every row has the same rounded value."""
    r = F.round(F.col(value).cast("double"), digits)
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(r).alias("n_values"),
        (F.min(r) == F.max(r)).alias("consistent"),
    )


def mean_by(df: DataFrame, keys: list[str], value: str, name: str = "mean",
            digits: int = 9) -> DataFrame:
    """Bar height: mean of ``value`` per key combination."""
    return df.groupBy(*keys).agg(F.round(F.avg(F.col(value).cast("double")), digits).alias(name))


def mean_with_band(df: DataFrame, keys: list[str], value: str, digits: int = 9,
                   z: float = 1.959963984540054) -> DataFrame:
    """Line point: mean, sample stddev, count and a normal-approximation 95 % band.

    The plotting library's band is a bootstrap; this closed form is its
    deterministic stand-in (documented difference).
    """
    v = F.col(value).cast("double")
    agg = df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("_m"), F.stddev_samp(v).alias("_s")
    )
    half = F.lit(z) * F.col("_s") / F.sqrt(F.col("n").cast("double"))
    return agg.select(
        *keys, "n", F.round("_m", digits).alias("mean"), F.round("_s", digits).alias("stddev"),
        F.round(F.col("_m") - half, digits).alias("ci_low"),
        F.round(F.col("_m") + half, digits).alias("ci_high"),
    )
