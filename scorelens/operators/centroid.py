"""The built-in, exactly checkable classifier: nearest centroid on Spark.

Training is ``posexplode`` + a (label, position) average (map-side combined), so
a label holding a third of all rows is reduced in every task first. The model
is one row per model name holding K class centroids of D values. It is trained once
(checkpointed); after a size check it is attached to every vector (scalar subquery, or a
broadcast join by model name for grids), and scoring is a per-row array expression (no
shuffle, no Python). Larger models are cut into parts of classes that rows are joined with.

Score of class c for vector v: ``sum(v * c) - 0.5 * sum(c * c)`` (equivalent to
the smallest Euclidean distance), rounded to 9 digits; the arg-max takes the
largest score and, on ties, the smallest class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelens.session import checkpoint_root

SCORE_DIGITS = 9
MAX_MODEL_VALUES = 10_000_000  # values of all models together that may travel to every task: 80 MB
PART_VALUES, SALTS = 1_000_000, 32  # of a larger model: values of one part, and copies of a part for its rows to spread over


def centroid_table(df: DataFrame, vec: str = "data", label: str = "label",
                   keys: list[str] | None = None) -> DataFrame:
    """Long form: (keys..., label, pos, centroid) = mean of position ``pos`` per label."""
    keys = keys or []
    exploded = df.select(*keys, F.col(label).alias("label"), F.posexplode(vec).alias("pos", "v"))
    return exploded.groupBy(*keys, "label", "pos").agg(F.avg(F.col("v").cast("double")).alias("centroid"))


def train_centroids(df: DataFrame, vec: str = "data", label: str = "label",
                    model: str = "centroid", model_col: str | None = None) -> DataFrame:
    """Model rows: (model, classes array<struct<label, centroid, half_norm>>).

    With ``model_col`` one model is trained per value of that column (a grid of
    training sets in one plan); otherwise a single model named ``model``.
    """
    keys = [model_col] if model_col else []
    long = centroid_table(df, vec, label, keys)
    per_class = long.groupBy(*keys, "label").agg(
        F.array_sort(F.collect_list(F.struct("pos", "centroid"))).alias("_pc")
    ).select(
        *keys, "label",
        F.transform("_pc", lambda x: x["centroid"]).alias("centroid"),
    ).withColumn(
        "half_norm",
        F.lit(0.5) * F.aggregate("centroid", F.lit(0.0), lambda acc, x: acc + x * x),
    )
    name = F.col(model_col).cast("string") if model_col else F.lit(model)
    return per_class.groupBy(name.alias("model")).agg(
        F.array_sort(F.collect_list(F.struct("label", "centroid", "half_norm"))).alias("classes")
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0),
                       lambda acc, x: acc + x)


def class_scores(vec: Column, classes: Column) -> Column:
    """array<struct<score, neg_label>> for every class of the model."""
    return F.transform(
        classes,
        lambda c: F.struct(
            F.round(_dot(vec, c["centroid"]) - c["half_norm"], SCORE_DIGITS).alias("score"),
            (-c["label"]).alias("neg_label"),
        ),
    )


def model_values(model: DataFrame) -> int:
    """Class x dimension values of all models together."""
    each = F.aggregate("classes", F.lit(0).cast("long"), lambda acc, c: acc + F.size(c["centroid"]))
    return model.agg(F.sum(each)).first()[0] or 0


def settled(model: DataFrame) -> DataFrame:
    """The model trained once: later reads find its rows."""
    checkpoint_root(model.sparkSession)
    return model.checkpoint(eager=True)


def check_model_size(model: DataFrame) -> None:
    """For scorers that hold a model in memory: fail unless it is small enough to travel to every task."""
    if (values := model_values(model)) > MAX_MODEL_VALUES:
        raise ValueError(f"model of {values} values is too large to travel to every task")


def model_literal(model: DataFrame, model_name: str = "centroid") -> Column:
    """The named model's classes as one literal value (size checked first).

    For a model reused many times in one session (every trigger of a stream):
    read once on the driver (bounded K x D), then attached to each micro-batch
    without re-running a subquery.
    """
    model = settled(model.filter(F.col("model") == F.lit(model_name)))
    check_model_size(model)
    row = model.select("classes").first()
    if row is None:
        raise ValueError(f"no model named {model_name}")
    return F.array(*[
        F.struct(F.lit(int(c["label"])).alias("label"),
                 F.array(*[F.lit(float(v)) for v in c["centroid"]]).alias("centroid"),
                 F.lit(float(c["half_norm"])).alias("half_norm"))
        for c in row["classes"]])


def predict_centroid(df: DataFrame, model: DataFrame | None, vec: str = "data",
                     model_name: str | None = None, keep_score: bool = False,
                     size_checked: bool = False, classes: Column | None = None) -> DataFrame:
    """Add ``pred`` (and optionally ``score``) to every row of ``df``.

    A single model (``model_name``, default "centroid") is attached as a scalar
    subquery: computed once, shipped to every task, no join. When ``df`` has its
    own ``model`` column (a grid), rows are matched to their model by a
    broadcast hash join on the name. The models' size is checked first (``size_checked``:
    the caller already did, e.g. once per stream); larger ones go by parts. ``classes``
    (from :func:`model_literal`) attaches an already-read model directly.
    """
    grid = model_name is None and "model" in df.columns
    if classes is not None:
        rows = df.withColumn("_classes", classes)
    else:
        if not grid:
            model = model.filter(F.col("model") == F.lit(model_name or "centroid"))
        if not size_checked:
            model = settled(model)
            if model_values(model) > MAX_MODEL_VALUES:
                return _by_parts(df, model, vec, grid, keep_score)
        if grid:
            rows = df.join(F.broadcast(model), "model").withColumnRenamed("classes", "_classes")
        else:
            rows = df.withColumn("_classes", model.select("classes").scalar())
    best = rows.withColumn("_best", F.array_max(class_scores(F.col(vec), F.col("_classes"))))
    return _with_prediction(best, keep_score).drop("_classes")


def _with_prediction(best: DataFrame, keep_score: bool) -> DataFrame:
    scored = best.withColumn("pred", (-F.col("_best.neg_label")).cast("int"))
    if keep_score:
        scored = scored.withColumn("score", F.col("_best.score"))
    return scored.drop("_best")


def _by_parts(df: DataFrame, model: DataFrame, vec: str, grid: bool, keep_score: bool) -> DataFrame:
    """Scores with a model of any size: its classes in parts of about PART_VALUES values, each row
    joined with every part of its model, and the best of all parts kept for each row."""
    at = F.floor(F.sum(F.size("c.centroid")).over(Window.partitionBy("model").orderBy("c.label")) / PART_VALUES)
    parts = settled(model.select("model", F.explode("classes").alias("c")).withColumn("part", at)
                    .groupBy("model", "part").agg(F.array_sort(F.collect_list("c")).alias("classes")))
    copies = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    numbered = settled(df.withColumn("_row", F.monotonically_increasing_id()))
    named = numbered.select("_row", F.col("model") if grid else F.lit("").alias("model"), F.col(vec).alias("v"))
    if not grid:
        parts, copies = parts.withColumn("model", F.lit("")), copies.withColumn("model", F.lit(""))
    per_model = parts.groupBy("model").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    spread = (named.join(per_model, "model").withColumn("part", F.explode("parts")).drop("parts")
              .withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")))
    scored = spread.join(copies, ["model", "part", "salt"]).withColumn("_best", F.array_max(class_scores(F.col("v"), F.col("classes"))))
    best = scored.groupBy("_row").agg(F.max("_best").alias("_best"))
    return _with_prediction(numbered.join(best, "_row").drop("_row"), keep_score)


def model_matrix(model: DataFrame) -> tuple[list[int], list[list[float]], list[float]]:
    """The K x D model as plain lists for vectorised scorers (size checked first)."""
    model = settled(model)
    check_model_size(model)
    row = model.select("classes").first()
    classes = row["classes"] if row else []
    return ([c["label"] for c in classes], [list(c["centroid"]) for c in classes],
            [c["half_norm"] for c in classes])
