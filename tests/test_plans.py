"""Plan shape: one shuffle for per-class accuracy, no Python in built-in paths,
column pruning and filter pushdown reach the parquet scan."""

from scorelens.operators import centroid, metrics
from scorelens.plans import testdata

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_class_accuracy_single_shuffle(spark):
    p = _plan(metrics.class_accuracy(testdata.line_predictions(spark, SF)))
    assert p.count("Exchange") == 1
    assert "partial_" in p or "PartialMerge" in p or "HashAggregate" in p


def test_centroid_scoring_stays_in_jvm(spark):
    data = testdata.labelled_arrays(spark, SF)
    p = _plan(centroid.predict_centroid(data, centroid.train_centroids(data)))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
                 "BroadcastNestedLoopJoin", "CartesianProduct", "SortMergeJoin"):
        assert node not in p
    assert "Subquery" in p  # the model is attached once as a scalar subquery


def test_grid_models_join_by_name(spark):
    from pyspark.sql import functions as F
    data = testdata.labelled_arrays(spark, SF).withColumn("model", F.concat(F.lit("m"), (F.col("label") % 2).cast("string")))
    models = centroid.train_centroids(data, model_col="model")
    p = _plan(centroid.predict_centroid(data, models))
    assert "BroadcastHashJoin" in p and "BroadcastNestedLoopJoin" not in p


def test_scan_prunes_columns_and_pushes_filters(spark):
    from pyspark.sql import functions as F
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    p = _plan(li.filter(F.col("l_linestatus") == "F").select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,F)]" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_linestatus:string>" in p


def test_training_report_scans_the_log_once(spark):
    rep = testdata.training_report(spark, SF)
    p = _plan(rep)
    assert p.count("lineitem.parquet") == 1
