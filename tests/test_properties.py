"""Properties: covers, permutations, partitions, counts, identities."""

from pyspark.sql import functions as F

from scorelens.operators import centroid, metrics, rows, splits
from scorelens.operators.relabel import normalise_by_max, unpivot
from scorelens.plans import testdata

SF = "/root/testdata/sf0.001"


def test_split_is_disjoint_cover(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    s = splits.hash_split(docs, "doc_id", 70)
    assert s.count() == docs.count()
    train = splits.train_part(docs, "doc_id", 70)
    rest = splits.rest_after(docs, train, "doc_id")
    assert train.count() + rest.count() == docs.count()
    assert train.join(rest, "doc_id").count() == 0


def test_shuffle_is_permutation(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    p = rows.shuffle_positions(docs, "doc_id", salt="x")
    n = docs.count()
    agg = p.agg(F.min("position"), F.max("position"), F.countDistinct("position"), F.countDistinct("doc_id")).first()
    assert tuple(agg) == (0, n - 1, n, n)


def test_row_numbers_dense_across_partitions(spark):
    df = spark.range(0, 5000, numPartitions=7).withColumn("k", (F.col("id") * 7919) % 5000)
    r = rows.with_row_number(df, [F.col("k")])
    assert r.filter(F.col("rn") != F.col("k")).count() == 0


def test_running_sum(spark):
    df = spark.range(1, 101, numPartitions=5).withColumn("v", F.col("id"))
    r = rows.with_running_sum(df, [F.col("id")], "v", "cs")
    assert r.filter(F.col("cs") != F.col("id") * (F.col("id") + 1) / 2).count() == 0


def test_unpivot_count_and_normalised_max(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_tax")
    u = unpivot(li, ["l_orderkey"])
    assert u.count() == 2 * li.count()
    n = normalise_by_max(li, ["l_quantity"])
    assert n.agg(F.max("l_quantity")).first()[0] == 1.0


def test_weighted_recall_equals_accuracy(spark):
    data = testdata.labelled_arrays(spark, SF)
    model = centroid.train_centroids(data)
    p = centroid.predict_centroid(data, model)
    w = metrics.weighted_metrics(p).first()
    acc = metrics.overall_accuracy(p).first()[0]
    assert abs(w["recall"] - round(acc, 6)) < 1e-9


def test_mean_of_batch_means_equals_accuracy_when_size_divides(spark):
    df = spark.range(0, 60).select(F.col("id"), (F.col("id") % 3 == 0).alias("correct"))
    b = rows.assign_constant(df, [F.col("id")], 6)
    a7 = metrics.mean_of_batch_means(b).first()["accuracy"]
    a6 = b.agg(F.avg(F.col("correct").cast("double"))).first()[0]
    assert abs(a7 - a6) < 1e-12


def test_centroid_udf_agrees_with_spark_predictor(spark):
    from scorelens.operators.scoring import predict_batch_column
    data = testdata.labelled_arrays(spark, SF)
    model = centroid.train_centroids(data)
    a = centroid.predict_centroid(data, model).select("id", "pred")
    b = data.select("id", predict_batch_column(model).alias("pred_udf"))
    assert a.join(b, "id").filter(F.col("pred") != F.col("pred_udf")).count() == 0


def test_balanced_equals_overall_with_equal_support(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("b", True)], "class string, correct boolean")
    pc = metrics.class_accuracy(df, duration=None)
    assert metrics.balanced_accuracy(pc).first()[0] == 75.0


def test_hot_key_is_packed_into_bounded_segments(spark):
    from scorelens.operators.generators import pack_segments
    # one key holds 3,000 of 3,100 items
    df = spark.range(0, 3100).select(F.when(F.col("id") < 3000, F.lit(1)).otherwise(F.col("id")).alias("k"),
                                     F.col("id").alias("v"))
    numbered = rows.with_row_number(df, [F.col("k"), F.col("v")])
    docs = pack_segments(numbered, "k", "rn", F.col("v"), 1000)
    hot = docs.filter(F.col("k") == 1).select("offset", F.size("items").alias("n")).orderBy("offset").collect()
    assert [(r["offset"], r["n"]) for r in hot] == [(0, 1000), (1000, 1000), (2000, 1000)]
    assert docs.agg(F.max(F.size("items"))).first()[0] <= 1000


def test_timed_scorer_one_call_per_batch_across_arrow_chunks(spark):
    from scorelens.operators.scoring import score_batches_in_pandas
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        data = testdata.labelled_arrays(spark, SF)
        model = centroid.train_centroids(data)
        b = rows.assign_constant(data, [F.col("id")], 10)
        out = score_batches_in_pandas(b, model)
        per = out.groupBy("batch_no").agg(F.countDistinct("batch_duration").alias("d"), F.count("*").alias("n"))
        assert per.filter(F.col("d") != 1).count() == 0
        assert out.count() == data.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tune_for_input_sizes_partitions(spark):
    from scorelens.session import tune_for_input
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        s = tune_for_input(spark, 100 * 1024 ** 4, 8000)
        assert int(s["spark.sql.shuffle.partitions"]) == 819200
        assert tune_for_input(spark, 10, 8)["spark.sql.shuffle.partitions"] == "16"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")


def test_native_sampling_options_cover(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    s = splits.native_split(docs, 70, seed=42)
    assert s.count() == docs.count() and s.select("doc_id").distinct().count() == docs.count()
    assert splits.bernoulli_sample(docs, "doc_id", 50, native_seed=7).count() <= docs.count()


def test_hot_key_top1_matches_window(spark):
    from pyspark.sql import Window
    from scorelens.operators.latest import latest_per_group
    df = spark.range(0, 3000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97).alias("run"),
        (F.col("id") * 7 % 101).cast("double").alias("step"), F.col("id").alias("pos"),
        (F.col("id") * 0.5).alias("v"))
    got = {r["run"]: (r["step"], r["v"]) for r in latest_per_group(df, ["run"], ["step", "pos"], ["step", "v"]).collect()}
    w = Window.partitionBy("run").orderBy(F.desc("step"), F.desc("pos"))
    want = {r["run"]: (r["step"], r["v"]) for r in
            df.withColumn("rk", F.row_number().over(w)).filter("rk = 1").collect()}
    assert got == want


def test_row_numbers_with_a_hot_leading_key(spark):
    df = spark.range(0, 6000, numPartitions=5).select(
        F.when(F.col("id") < 2000, F.lit(0)).otherwise(F.col("id") % 50 + 1).alias("k"), F.col("id"))
    r = rows.with_row_number(df, [F.col("k"), F.col("id")])
    agg = r.agg(F.min("rn"), F.max("rn"), F.countDistinct("rn")).first()
    assert tuple(agg) == (0, 5999, 6000)
    first_hot = r.filter(F.col("k") == 0).agg(F.min("rn"), F.max("rn")).first()
    assert tuple(first_hot) == (0, 1999)
