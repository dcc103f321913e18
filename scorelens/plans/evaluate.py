"""Evaluation workflows: prepare, batch, score and reduce; parameter grids in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.functions.hashing import md5_bucket
from scorelens.functions.text import WHITESPACE
from scorelens.operators import naive_bayes, rows, splits
from scorelens.operators.centroid import predict_centroid, train_centroids
from scorelens.operators.joins import lookup
from scorelens.operators.metrics import binary_metrics
from scorelens.operators.scoring import score_batches_in_pandas
from scorelens.operators.term_vectors import DIMS, predict_sparse, term_buckets, term_matrix, train_sparse_centroids


def prepare_text(labelled: DataFrame, train_pct: int = 98, salt: str = "mix") -> DataFrame:
    """Read -> shuffle -> split: (doc_id, content, label, split, position)."""
    shuffled = rows.shuffle_positions(labelled, "doc_id", salt=salt)
    return splits.hash_split(shuffled, "doc_id", train_pct).select(
        "doc_id", "content", "label", "split", "position")


def collate(batched: DataFrame, batch: str, position: str, lists: dict[str, str]) -> DataFrame:
    """Items -> one row per batch with lists in position order.

    Batches come from a fixed batch size, so every group is bounded by it.
    """
    packed = F.array_sort(F.collect_list(F.struct(F.col(position).alias("_p"),
                                                  *[F.col(c).alias(c) for c in lists.values()])))
    out = batched.groupBy(batch).agg(packed.alias("_items"))
    return out.select(batch, *[F.transform("_items", _field(c)).alias(name) for name, c in lists.items()])


def _field(name: str):
    return lambda x: x[name]


def grid_accuracy(labelled: DataFrame, train_pcts: list[int], salt: str = "grid",
                  vec: str = "data") -> DataFrame:
    """Train one centroid model per training fraction and score its held-out rows.

    All grid points run in one plan: each row is tagged with the grid points it
    trains or tests (an array explode over a fixed, small grid; no join).
    """
    grid = F.array(*[F.lit(p) for p in train_pcts])
    tagged = labelled.withColumn("_bucket", md5_bucket(F.col("id"), 100, salt)).withColumn(
        "_pct", F.explode(grid))
    run = F.concat(F.lit("centroid_"), F.col("_pct").cast("string"))
    train = tagged.filter(F.col("_bucket") < F.col("_pct")).withColumn("model", run)
    test = tagged.filter(F.col("_bucket") >= F.col("_pct")).withColumn("model", run)
    models = train_centroids(train, vec=vec, model_col="model")
    scored = predict_centroid(test, models, vec=vec)
    return scored.groupBy(F.col("model").alias("run")).agg(
        F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))


def with_batches(shuffled: DataFrame, batch_sizes: list[int], position: str = "position") -> DataFrame:
    """Every grid batch size at once: rows x grid points, batch_no = position div size."""
    grid = F.explode(F.array(*[F.lit(b) for b in batch_sizes])).alias("batch_size")
    return shuffled.select("*", grid).withColumn("batch_no", F.floor(F.col(position) / F.col("batch_size")))


def evaluate_arrays(labelled: DataFrame, model: DataFrame, names: DataFrame, batch_sizes: list[int],
                    model_name: str = "centroid", salt: str = "shuffle", env: str = "spark") -> DataFrame:
    """Image-style evaluation for a grid of batch sizes in one plan.

    Shuffle (reproducibly), cut into batches, score each batch with one timed
    vectorised call, then reduce: class accuracy -> balanced accuracy (3 digits),
    class mean batch time -> average batch duration (5 digits). Every row is scored
    once: an item carries its batch's seconds and size, so that their ratio adds up to the
    run's seconds in the same aggregate.
    """
    shuffled = rows.shuffle_positions(labelled, "id", salt=salt)
    scored = score_batches_in_pandas(with_batches(shuffled, batch_sizes), model, keys=("batch_size", "batch_no"))
    per_label = scored.groupBy("batch_size", "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("label") == F.col("pred")).cast("double")).alias("hits"),
        F.avg("batch_duration").alias("avg_batch"),
        F.sum(F.col("batch_duration") / F.col("batch_rows")).alias("seconds"))
    return lookup(per_label, names, "label", flag=None).groupBy("batch_size").agg(
        F.round(F.sum("seconds"), 3).alias("duration"),
        F.sum("n").alias("total_images"),
        F.round(F.avg("avg_batch"), 5).alias("average_batch_duration"),
        F.round(F.avg(F.lit(100.0) * F.col("hits")), 3).alias("balanced_accuracy"),
    ).select(F.lit(model_name).alias("model"), "duration", "total_images", F.col("batch_size").cast("int"),
             "average_batch_duration", "balanced_accuracy", F.lit(env).alias("env"))


def text_features(prepared: DataFrame, dims: int = DIMS) -> DataFrame:
    """Prepared texts as sparse hashed term vectors."""
    return prepared.select(F.col("doc_id").alias("id"), "label", "split", "position", term_buckets("content", dims).alias("terms"))


def evaluate_texts(prepared: DataFrame, batch_sizes: list[int], dims: int = DIMS, model_name: str = "centroid-terms",
                   timed: bool = True) -> DataFrame:
    """Text-style evaluation for a grid of batch sizes in one plan.

    Train the centroid model on the train split's term vectors, score the test split, and reduce per grid
    point to the unweighted mean of batch accuracies. With ``timed`` batches go through the vectorised
    scorer, one measured call each, and the result has the run's seconds and those per batch; else a text is scored once, in the JVM.
    """
    feats = text_features(prepared, dims)
    model = train_sparse_centroids(feats.filter(F.col("split") == "train"), dims=dims)
    test = rows.with_row_number(feats.filter(F.col("split") == "test"), [F.col("position")], name="test_pos")
    if timed:
        scored = score_batches_in_pandas(with_batches(test, batch_sizes, "test_pos"), model, vec="terms",
                                         keys=("batch_size", "batch_no"), matrix=term_matrix(dims))
        seconds = [F.max("batch_duration").alias("secs")]
    else:
        scored, seconds = with_batches(predict_sparse(test, model).drop("terms"), batch_sizes, "test_pos"), []
    per_batch = scored.groupBy("batch_size", "batch_no").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("pred")).cast("double")).alias("acc"), *seconds)
    took = [F.round(F.sum("secs"), 5).alias("duration"), F.round(F.avg("secs"), 5).alias("average_batch_duration")] if timed else []
    return per_batch.groupBy("batch_size").agg(
        F.lit(model_name).alias("model"), F.sum("n").alias("total_texts"), F.count(F.lit(1)).alias("batches"),
        F.round(F.avg("acc"), 9).alias("accuracy"), *took)


def text_batch_scores(prepared: DataFrame, batch_size: int, dims: int = DIMS, timed: bool = True) -> DataFrame:
    """One row per scored text batch: size, mean hit rate and, with ``timed``, seconds."""
    feats = text_features(prepared, dims)
    model = train_sparse_centroids(feats.filter(F.col("split") == "train"), dims=dims)
    batched = feats.withColumn("batch_no", F.floor(F.col("position") / batch_size))
    if timed:
        scored = score_batches_in_pandas(batched, model, vec="terms", keys=("batch_no",), matrix=term_matrix(dims))
    else:
        scored = predict_sparse(batched, model)
    return scored.groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("pred")).cast("double")), 9).alias("accuracy"),
        *([F.max("batch_duration").alias("seconds")] if timed else []))


def text_bayes_eval(labelled: DataFrame, train_pct: int = 70, salt: str = "s42") -> DataFrame:
    """Naive Bayes from the exact term counts of the train split, its binary metrics on the held-out split."""
    data = splits.hash_split(labelled, "doc_id", train_pct, salt=salt)
    model = naive_bayes.train(data.filter(F.col("split") == "train"))
    test = data.filter(F.col("split") == "test")
    pred = naive_bayes.predict(test, model)
    return binary_metrics(test.select("doc_id", "label").join(pred, "doc_id"))


def text_pipeline_eval(labelled: DataFrame, train_pct: int = 70, salt: str = "s42",
                       num_features: int = 4096, max_iter: int = 5) -> DataFrame:
    """Fit tokenizer -> hashed term frequencies -> logistic regression on the
    train split and report binary metrics on the test split (distributed fit)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer


    data = splits.hash_split(labelled, "doc_id", train_pct, salt=salt)
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol="content", outputCol="tokens", pattern=WHITESPACE, toLowercase=True),
        HashingTF(inputCol="tokens", outputCol="features", numFeatures=num_features),
        LogisticRegression(featuresCol="features", labelCol="label_d", maxIter=max_iter),
    ])
    train = data.filter(F.col("split") == "train").withColumn("label_d", F.col("label").cast("double"))
    fitted = pipe.fit(train)
    test = data.filter(F.col("split") == "test").withColumn("label_d", F.col("label").cast("double"))
    pred = fitted.transform(test).select("label", F.col("prediction").cast("int").alias("pred"))
    return binary_metrics(pred)
