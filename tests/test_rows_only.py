"""Keys without a SQL oracle, checked against direct computations at sf0.001."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from scorelens.operators import centroid, metrics, splits
from scorelens.operators.term_vectors import predict_sparse, train_sparse_centroids
from scorelens.plans import evaluate, testdata
from scorelens.plans.prepare_queries import TRAIN_PCT, TRAIN_PCT_TEXT
from scorelens.plans.workflow_queries import IMAGE_BATCH_SIZES, TEXT_BATCH_SIZES
from scorelens.sources import dims

SF = "/root/testdata/sf0.001"


def split_arrays(spark):
    data = splits.hash_split(testdata.labelled_arrays(spark, SF), "id", TRAIN_PCT)
    return data.filter(F.col("split") == "train"), data.filter(F.col("split") == "test")


def test_evaluate_arrays_grid_against_direct(spark):
    train, test = split_arrays(spark)
    model = centroid.train_centroids(train)
    timed = evaluate.evaluate_arrays(test, model, dims.label_names(spark), IMAGE_BATCH_SIZES, env="here")
    assert timed._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    timed = {r["batch_size"]: r for r in timed.collect()}
    grid = {r["batch_size"]: r for r in E.queries()["evaluate_arrays_grid"](spark, SF).collect()}
    assert sorted(grid) == sorted(timed) == IMAGE_BATCH_SIZES
    pred = centroid.predict_centroid(test, model)
    named = pred.join(dims.label_names(spark), "label").withColumn("correct", F.col("label") == F.col("pred"))
    direct = metrics.balanced_accuracy(metrics.class_accuracy(named, cls="name", duration=None)).first()[0]
    n = test.count()
    for size, r in grid.items():
        assert r["balanced_accuracy"] == timed[size]["balanced_accuracy"] == direct and r["total_images"] == n
        assert timed[size]["duration"] >= 0 and timed[size]["average_batch_duration"] >= 0 and timed[size]["env"] == "here"


def test_models_beyond_the_bound_are_scored_by_parts(spark, monkeypatch):
    train, test = split_arrays(spark)
    model = centroid.train_centroids(train)
    whole = centroid.predict_centroid(test, model, keep_score=True).select("id", "pred", "score")
    pcts = [50, 90]
    grid = evaluate.grid_accuracy(testdata.labelled_arrays(spark, SF), pcts).collect()
    monkeypatch.setattr(centroid, "MAX_MODEL_VALUES", 100)
    monkeypatch.setattr(centroid, "PART_VALUES", 200)  # three classes of 64 values or so a part
    parts = centroid.predict_centroid(test, model, keep_score=True).select("id", "pred", "score")
    assert sorted(parts.collect()) == sorted(whole.collect())
    assert sorted(evaluate.grid_accuracy(testdata.labelled_arrays(spark, SF), pcts).collect()) == sorted(grid)


def test_score_map_in_pandas_against_spark_predictor(spark):
    out = E.queries()["score_map_in_pandas"](spark, SF)
    data = testdata.labelled_arrays(spark, SF)
    pred = centroid.predict_centroid(data, centroid.train_centroids(data)).select("id", F.col("pred").alias("p2"))
    assert out.count() == data.count()
    assert out.join(pred, "id").filter(F.col("pred") != F.col("p2")).count() == 0


def test_text_grid_and_batches(spark):
    prepared = evaluate.prepare_text(testdata.labelled_text(spark, SF), TRAIN_PCT_TEXT)
    n_test = prepared.filter(F.col("split") == "test").count()
    grid = E.queries()["evaluate_texts_grid"](spark, SF).collect()
    assert sorted(r["batch_size"] for r in grid) == TEXT_BATCH_SIZES
    feats = evaluate.text_features(prepared)
    model = train_sparse_centroids(feats.filter(F.col("split") == "train"))
    direct = metrics.overall_accuracy(predict_sparse(feats.filter(F.col("split") == "test"), model)).first()[0]
    timed = {r["batch_size"]: r for r in evaluate.evaluate_texts(prepared, TEXT_BATCH_SIZES).collect()}
    for r in grid:
        assert r["total_texts"] == n_test and abs(r["accuracy"] - timed[r["batch_size"]]["accuracy"]) < 1e-9
        assert timed[r["batch_size"]]["duration"] >= 0 and timed[r["batch_size"]]["average_batch_duration"] >= 0
        if r["batch_size"] == 1:  # batches of one: mean of batch means = row accuracy
            assert abs(r["accuracy"] - direct) < 1e-9
    batches = E.queries()["score_text_batches"](spark, SF)
    assert batches.agg(F.sum("n")).first()[0] == testdata.labelled_text(spark, SF).count()


def test_text_train_eval_metrics_in_range(spark):
    r = E.queries()["text_train_logistic"](spark, SF).first()
    for k in ("accuracy", "precision", "recall", "f1"):
        assert 0.0 <= r[k] <= 1.0
