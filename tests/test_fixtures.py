"""Hand-computed fixtures in the reference's shapes (FIXTURES.md)."""

import json
import os

import pytest
from pyspark.sql import functions as F

from scorelens.functions.arrays import argmax, channel_to_pixel_major, wrap_uint8
from scorelens.functions.text import inner_path, tokens_mask, tokens_pad_truncate
from scorelens.operators import metrics, rows
from scorelens.operators.generators import explode_with_position
from scorelens.operators.latest import latest_per_group
from scorelens.operators.relabel import normalise_by_max
from scorelens.plans import reports
from scorelens.session import scratch_path
from scorelens.sources import files, sinks
from scorelens.streaming import IMAGE_SCHEMA


def test_fx1_channel_transpose_and_edge_files(spark):
    base = scratch_path(spark, "fx1").removeprefix("file:")
    os.makedirs(base)
    with open(f"{base}/batch_1.json", "w") as f:
        json.dump([{"idx": 1, "data": [1, 2, 3, 4, 5, 6, 7, 8], "label": 4},
                   {"idx": 1, "data": [9, 10, 11, 12, 13, 14, 15, 16], "label": 2}], f)
    with open(f"{base}/batch_2.json", "w") as f:
        json.dump([], f)
    with open(f"{base}/batch_3.json", "w") as f:
        json.dump([{"idx": 3, "label": 1}], f)
    df = spark.read.schema(IMAGE_SCHEMA).json(base).filter(F.col("data").isNotNull())
    out = df.select("label", channel_to_pixel_major("data", 2).alias("p")).orderBy(F.desc("label")).collect()
    assert len(out) == 2
    assert out[0]["p"] == [1.0, 5.0, 2.0, 6.0, 3.0, 7.0, 4.0, 8.0]


def test_argmax_first_wins_and_uint8_wraps(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 2.0], [255, 256, -1, 300])], "a array<double>, b array<int>")
    r = df.select(argmax("a").alias("m"), wrap_uint8("b").alias("w")).first()
    assert r["m"] == 1
    assert r["w"] == [255, 0, 255, 44]


FX2 = [(1, 5, 100.0, 0.0, 0.0, 0.0, "mac_cpu"), (2, 10, 110.0, 112.5, 117.5, 80.0, "mac_cpu"),
       (3, 15, 120.5, 120.0, 123.0, 100.0, "cuda"), (4, 20, 130.0, 131.0, 131.0, 95.0, "cuda")]
FX2_SCHEMA = "batch_id bigint, batch_size bigint, triggered double, start double, `end` double, accuracy double, env string"


def test_fx2_tracker_latency_throughput(spark):
    t = spark.createDataFrame(FX2, FX2_SCHEMA).withColumn("model", F.lit("m"))
    m = {r["batch_id"]: r for r in reports.stream_metrics(t).collect()}
    assert m[1]["latency"] is None and m[1]["throughput"] is None and not m[1]["completed"]
    assert m[2]["latency"] == 2.5 and m[2]["throughput"] == 2.0
    assert m[3]["latency"] == -0.5 and m[3]["clock_skew"] and m[3]["throughput"] == 5.0
    assert m[4]["latency"] == 1.0 and m[4]["throughput"] is None
    rep = reports.stream_report(t.withColumn("env", F.lit("e"))).first()
    assert rep["batches"] == 3 and rep["mean_latency"] == 1.0 and rep["zero_spans"] == 1 and rep["clock_skews"] == 1


def test_fx3_runs_keyed_by_file_and_last_position_wins(spark):
    log = "array<struct<step:double,eval_accuracy:double>>"
    states = spark.createDataFrame([
        ("results/g/m:COLAB_GPU/x/trainer_state.json", [(1.0, 0.5), (2.0, 0.7), (2.0, 0.8)]),
        ("results/g/m/x/trainer_state.json", [(1.0, 0.4), (3.0, 0.9)]),
    ], f"path string, log_history {log}")
    ex = explode_with_position(states, "log_history", ["path"])
    flat = ex.select("path", "pos", "log.step", "log.eval_accuracy").filter(F.col("eval_accuracy").isNotNull())
    best = {r["path"]: r for r in latest_per_group(flat, ["path"], ["step", "pos"], ["step", "eval_accuracy"]).collect()}
    assert len(best) == 2
    assert best["results/g/m:COLAB_GPU/x/trainer_state.json"]["eval_accuracy"] == 0.8
    runs = reports.trainer_runs_from_paths(states.withColumn("total_flos", F.lit(1.0)))
    assert sorted((r["model"], r["env"]) for r in runs.collect()) == [("g/m", "COLAB_GPU"), ("g/m", "GPU")]


def test_fx4_numeric_max_not_lexicographic(spark):
    df = spark.createDataFrame([("9.5",), ("10.0",)], "train_runtime string")
    out = normalise_by_max(df.select(F.col("train_runtime").cast("double").alias("x")), ["x"])
    assert sorted(r["x"] for r in out.collect()) == [0.95, 1.0]


def test_fx5_consistency_verdict(spark):
    df = spark.createDataFrame([("a", "cpu", 98.81), ("a", "cuda", 98.81), ("b", "cpu", 97.5), ("b", "cuda", 97.6),
                                ("c", "cpu", 80.2661), ("c", "cuda", 80.2659)], "model string, env string, acc double")
    v = {r["model"]: r["consistent"] for r in metrics.consistency_verdict(df, "model", "acc").collect()}
    assert v == {"a": True, "b": False, "c": True}
    detail = metrics.consistency_rows(df, "model", "env", "acc", key_name="model_name")
    assert detail.count() == 6


def test_fx7_labelled_text_csv_round_trip(spark):
    rows_in = [("good day", "0"), ('bad, "quoted" text', "1"), ("line one\nline two", "1"),
               ("header again", "Label"), ("no label", None)]
    path = scratch_path(spark, "fx7")
    sinks.write_csv(spark.createDataFrame(rows_in, "Content string, Label string"), path, text_safe=True)
    got = sorted((r["content"], r["label"]) for r in files.read_labelled_text(spark, path).collect())
    assert got == sorted([("good day", 0), ('bad, "quoted" text', 1), ("line one\nline two", 1)])


def test_fx7_tokens(spark):
    r = spark.createDataFrame([("Good  day",)], "t string").select(
        tokens_pad_truncate("t", 4).alias("tok"), tokens_mask("t", 4).alias("mask")).first()
    assert r["tok"] == ["good", "day", "[PAD]", "[PAD]"] and r["mask"] == [1, 1, 0, 0]


FX8 = [(1, 0, "a", 0, 0, 1.0), (2, 0, "a", 0, 1, 1.0), (3, 0, "b", 1, 1, 1.0), (4, 1, "b", 1, 1, 3.0)]
FX8_SCHEMA = "id bigint, batch_no int, class string, label int, pred int, batch_duration double"


def test_fx8_prediction_metrics(spark):
    p = spark.createDataFrame(FX8, FX8_SCHEMA).withColumn("correct", F.col("label") == F.col("pred"))
    pc = metrics.class_accuracy(p)
    acc = {r["class"]: r["accuracy"] for r in pc.collect()}
    assert acc == {"a": 50.0, "b": 100.0}
    assert metrics.balanced_accuracy(pc).first()[0] == 75.0
    assert metrics.class_mean_batch_duration(pc).first()[0] == 1.5
    assert metrics.overall_accuracy(p).first()[0] == 0.75
    assert metrics.mean_of_batch_means(p).first()["accuracy"] == pytest.approx(0.8333333, abs=1e-6)
    b = metrics.binary_metrics(p).first()
    assert (b["tp"], b["fp"], b["fn"]) == (2, 1, 0)
    assert b["precision"] == pytest.approx(2 / 3) and b["recall"] == 1.0 and b["f1"] == pytest.approx(0.8)
    w = metrics.weighted_metrics(p).first()
    assert w["precision"] == pytest.approx(0.833333, abs=1e-6) and w["recall"] == 0.75
    assert w["f1"] == pytest.approx(0.733333, abs=1e-6)


def test_fx8_undefined_ratios_are_zero(spark):
    p = spark.createDataFrame([(1, 0), (1, 0)], "label int, pred int")
    b = metrics.binary_metrics(p).first()
    assert b["precision"] == 0.0 and b["recall"] == 0.0 and b["f1"] == 0.0


def test_fx9_dimensions(spark):
    from scorelens.sources import dims
    assert dims.label_names(spark).count() == 10
    cat = {r["model"]: r["params"] for r in dims.catalog(spark).collect()}
    assert len(cat) == 16 and cat["google/vit-base-patch16-224"] == 86.568


def test_fx10_schedules(spark):
    df = spark.range(0, 680).withColumnRenamed("id", "k")
    inc = rows.assign_increasing(df, [F.col("k")], 5).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in inc] == [5 * i for i in range(1, 17)]
    const = rows.assign_constant(spark.range(120), [F.col("id")], 50).groupBy("batch_no").count().orderBy("batch_no")
    assert [r["count"] for r in const.collect()] == [50, 50, 20]
    rnd = rows.assign_random(spark.range(1000), [F.col("id")], 50, 200).groupBy("batch_id").count()
    sizes = [r["count"] for r in rnd.orderBy("batch_id").collect()]
    assert sum(sizes) == 1000 and all(50 <= s <= 200 for s in sizes[:-1])


def test_path_helpers(spark):
    r = spark.createDataFrame([("results/facebook/deit/models",)], "p string").select(inner_path("p")).first()
    assert r[0] == "facebook/deit"


def test_t5_placeholder_is_text(spark):
    from scorelens.functions.times import placeholder_zero
    df = spark.createDataFrame([(0.0,), (1.5,)], "start double")
    got = sorted(r[0] for r in df.select(placeholder_zero("start")).collect())
    assert got == ["-", "1.5"]


def test_t15_csv_sink_has_no_index_column(spark):
    path = scratch_path(spark, "t15")
    sinks.write_csv(spark.createDataFrame([("m", 1.0)], "model string, duration double"), path)
    assert files.read_csv_text(spark, path).columns == ["model", "duration"]


def test_training_report_default_order_is_step_then_position(spark):
    from scorelens.sources import dims
    runs = spark.createDataFrame([(1, "google/vit-base-patch16-224", "GPU", 1.0), (2, "g/unknown", "COLAB_GPU", 2.0)],
                                 "run_id bigint, model string, env string, total_flos double")
    d = "double"
    entries = spark.createDataFrame([
        (1, 1.0, 0, None, None, None, 0.5, 0.5, 0.1, 3.0),
        (1, 2.0, 1, None, None, None, 0.7, 0.7, 0.2, 3.0),
        (1, 2.0, 2, None, None, None, 0.8, 0.8, 0.3, 3.0),   # same step, later position: wins
        (1, 2.0, 3, 100.0, 5.0, 0.1, None, None, None, None),
        (2, 1.0, 0, 50.0, 4.0, 0.2, 0.6, 0.6, 0.4, 2.0),
    ], f"run_id bigint, step {d}, pos int, train_runtime {d}, train_samples_per_second {d}, "
       f"train_steps_per_second {d}, eval_accuracy {d}, eval_f1 {d}, eval_loss {d}, eval_runtime {d}")
    rep = {r["run_id"]: r for r in reports.training_report(runs, entries, dims.catalog(spark)).collect()}
    assert rep[1]["eval_accuracy"] == 0.8 and rep[1]["model"] == "google/vit-base-patch16-224"
    assert rep[1]["params"] == "86.568M" and not rep[1]["missing_model"]
    assert rep[2]["missing_model"] and rep[2]["params"] is None and rep[2]["train_runtime"] == 50.0


def test_fx3_trainer_state_files_end_to_end(spark):
    from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType
    from scorelens.sources import dims
    base = scratch_path(spark, "fx3-files").removeprefix("file:")
    for name, flos in {"google/vit-base-patch16-224:COLAB_GPU": 1.0, "google/vit-base-patch16-224": 2.0}.items():
        group, model = name.split("/")
        d = os.path.join(base, "results", group, model, "run1")
        os.makedirs(d)
        with open(os.path.join(d, "trainer_state.json"), "w") as fh:
            json.dump({"total_flos": flos, "train_batch_size": 32, "global_step": 97, "log_history": [
                {"loss": 1.0, "step": 1},
                {"step": 2, "eval_accuracy": 0.5, "eval_f1": 0.5, "eval_loss": 0.3, "eval_runtime": 5.0},
                {"step": 2, "eval_accuracy": 0.75, "eval_f1": 0.7, "eval_loss": 0.2, "eval_runtime": 5.0},
                {"step": 3, "train_runtime": 100.0, "train_samples_per_second": 1.0, "train_steps_per_second": 0.5},
            ]}, fh, indent=2)
    log = StructType([StructField(n, FloatType()) for n in (
        "loss", "step", "eval_loss", "eval_accuracy", "eval_f1", "eval_runtime", "train_runtime",
        "train_samples_per_second", "train_steps_per_second")])
    schema = StructType([StructField("total_flos", FloatType()), StructField("train_batch_size", IntegerType()),
                         StructField("global_step", IntegerType()), StructField("log_history", ArrayType(log))])
    states = files.read_named_json_documents(spark, f"{base}/results", "trainer_state.json", schema)
    runs = reports.trainer_runs_from_paths(states)
    entries = explode_with_position(states.withColumnRenamed("path", "run_id"), "log_history",
                                    ["run_id"]).select("run_id", "pos", "log.*")
    rep = reports.training_report(runs, entries, dims.catalog(spark)).collect()
    assert sorted(r["env"] for r in rep) == ["COLAB_GPU", "GPU"]           # 2 rows, not 4 (T13)
    assert all(r["eval_accuracy"] == 0.75 and r["params"] == "86.568M" for r in rep)  # last position wins (T14)


def test_fx2_tracker_files_with_logs_beside_them(spark):
    base = scratch_path(spark, "fx2-files").removeprefix("file:")
    for run, rows_ in {"ConvNext_cpu": FX2[:2], "ViT_cuda": FX2[2:]}.items():
        os.makedirs(f"{base}/{run}")
        with open(f"{base}/{run}/tracker.json", "w") as fh:
            for r in rows_:
                fh.write(json.dumps(dict(zip(["batch_id", "batch_size", "triggered", "start", "end", "accuracy", "env"],
                                             r))) + "\n")
        with open(f"{base}/{run}/trigger.log", "w") as fh:
            fh.write("Pushed 1 data\nnot json at all\n")
    trackers = files.read_with_path_columns(spark, base, "json", {"run": r"/([^/]+)/[^/]*$"},
                                            file_name="tracker.json")
    assert trackers.count() == 4
    rep = {(r["model"], r["env"]): r for r in reports.stream_report(reports.runs_from_path(trackers, "run")).collect()}
    assert rep[("ConvNext", "MAC_CPU")]["batches"] == 1 and rep[("ConvNext", "MAC_CPU")]["mean_latency"] == 2.5
    assert rep[("ViT", "LINUX_GPU")]["batches"] == 2 and rep[("ViT", "LINUX_GPU")]["zero_spans"] == 1


def test_fx4_training_chart_from_text_csv(spark):
    path = scratch_path(spark, "fx4").removeprefix("file:")
    os.makedirs(path)
    with open(f"{path}/training_results.csv", "w") as fh:
        fh.write(",model,env,total_flos,train_runtime,train_samples_per_second,train_steps_per_second\n")
        fh.write("0,google/vit-base-patch16-224,GPU,2.0,9.5,20.0,0.2\n")
        fh.write("1,facebook/deit-tiny-patch16-224,COLAB_GPU,4.0,10.0,40.0,0.4\n")
        fh.write("2,some/other-model,GPU,8.0,99.0,80.0,0.8\n")   # not charted: excluded before the maxima
    chart = reports.training_chart(files.read_csv_text(spark, path))
    got = {(r["env"], r["category"], r["model"]): r["mean"] for r in chart.collect()}
    assert got[("MAC_GPU", "runtime", "ViT")] == 0.95 and got[("LINUX_GPU", "runtime", "DeiT")] == 1.0
    assert got[("MAC_GPU", "flos", "ViT")] == 0.5 and len(got) == 8


def test_fx5_benchmark_csv_charts_and_consistency(spark):
    from scorelens.plans.io_queries import INFERENCE_SCHEMA
    path = scratch_path(spark, "fx5").removeprefix("file:")
    os.makedirs(path)
    rows_ = [
        ("aaraki/vit-base-patch16-224-in21k-finetuned-cifar10", 99.9, 200, 1, 0.86, 98.81, "cpu"),
        ("aaraki/vit-base-patch16-224-in21k-finetuned-cifar10", 14.4, 200, 1, 0.49, 98.81, "mac_cpu"),
        ("tzhao3/DeiT-CIFAR10", 20.8, 200, 1, 0.07, 97.5, "cuda"),
        ("tzhao3/DeiT-CIFAR10", 20.1, 200, 1, 0.08, 97.6, "tpu"),
        ("facebook/deit-tiny-patch16-224", 23.7, 200, 1, 0.10, 74.861, "cpu"),
    ]
    with open(f"{path}/bench.csv", "w") as fh:
        fh.write("model,duration,total_images,batch_size,average_batch_duration,balanced_accuracy,env\n")
        for r in rows_:
            fh.write(",".join(str(x) for x in r) + "\n")
    bench = files.read_csv_typed(spark, path, INFERENCE_SCHEMA)
    chart = {(r["model"], r["env"]) for r in reports.batch_size_chart(bench).collect()}
    assert chart == {("ViT", "LINUX_CPU"), ("ViT", "MAC_CPU"), ("DeiT", "LINUX_CUDA"), ("DeiT", "tpu")}
    verdict = {r["model"]: r["consistent"] for r in reports.consistency_check(bench).collect()}
    assert verdict["aaraki/vit-base-patch16-224-in21k-finetuned-cifar10"] is True
    assert verdict["tzhao3/DeiT-CIFAR10"] is False


def test_fx6_text_results_with_index_column(spark):
    path = scratch_path(spark, "fx6").removeprefix("file:")
    os.makedirs(path)
    with open(f"{path}/text.csv", "w") as fh:
        fh.write(",model,duration,total_texts,batch_size,average_batch_duration,accuracy,env\n")
        fh.write("0,huawei-noah/TinyBERT_General_4L_312D,2.34515,200,1,0.01173,0.77,mac_cpu\n")
        fh.write("1,huawei-noah/TinyBERT_General_4L_312D,0.48142,200,2,0.00481,0.465,mac_cpu\n")
    schema = ("_index int, model string, duration double, total_texts int, batch_size int, "
              "average_batch_duration double, accuracy double, env string")
    df = files.read_csv_typed(spark, path, schema).drop("_index")
    assert df.columns[0] == "model" and df.count() == 2
    # wall time per batch = duration / number of batches (200 texts / batch size)
    got = sorted(round(r["duration"] / (r["total_texts"] / r["batch_size"]), 5) for r in df.collect())
    assert got == [0.00481, 0.01173]
