"""Streaming: stream result = batch result; reruns and replays change nothing;
interleaved producer/consumer appends lose no tracker row."""

import pytest
from pyspark.sql import functions as F

from scorelens.operators.centroid import predict_centroid, settled, train_centroids
from scorelens.plans import testdata
from scorelens.session import scratch_path
from scorelens.streaming import produce_micro_batches, run_scoring_stream, tracker_view
from scorelens.streaming.live import run_live
from scorelens.streaming.microbatch import producer_of, push_micro_batches
from scorelens.streaming.progress import trigger_log
from scorelens.streaming.rejects import parse_records, rejects, write_rejects
from scorelens.streaming.scoring import consumer_of, score_micro_batch
from scorelens.streaming.source_log import IDENTITY, reconcile, register_files
from scorelens.streaming.tracker import read_log

SF = "/root/testdata/sf0.001"
COLUMNS = ["batch_id", "batch_size", "scored", "accuracy"]


def test_stream_equals_batch_and_replay_is_idempotent(spark):
    base = scratch_path(spark, "t-stream")
    data = testdata.labelled_arrays(spark, SF)
    model = train_centroids(data)
    produce_micro_batches(data, f"{base}/in", f"{base}/tr", [F.col("id")], "increasing", 5)
    run_scoring_stream(spark, f"{base}/in", model, f"{base}/tr", f"{base}/ck", timeout_s=300)
    first = sorted(tuple(r) for r in tracker_view(spark, f"{base}/tr").select(*COLUMNS).collect())
    run_scoring_stream(spark, f"{base}/in", model, f"{base}/tr", f"{base}/ck", timeout_s=300)
    replay = spark.read.json(f"{base}/in", schema="idx int, data array<float>, label int").filter(F.col("idx") == 1)
    score_micro_batch(replay, 0, model, f"{base}/tr", producer=producer_of(f"{base}/in"), consumer=consumer_of(f"{base}/ck"))
    again = sorted(tuple(r) for r in tracker_view(spark, f"{base}/tr").select(*COLUMNS).collect())
    assert first == again
    # batch result on the same rows
    pred = predict_centroid(data, model)
    n = pred.count()
    assert sum(r[2] for r in first) == n  # every row scored exactly once
    hits = pred.filter(F.col("pred") == F.col("label")).count()
    assert abs(sum(r[1] * r[3] / 100.0 for r in first) - hits) < 1e-6 * n + 0.01 * len(first)


def test_interleaved_producer_appends_lose_nothing(spark):
    base = scratch_path(spark, "t-tracker")
    data = testdata.labelled_arrays(spark, SF)
    model = train_centroids(data)
    a = data.filter(F.col("id") % 2 == 0)
    b = data.filter(F.col("id") % 2 == 1).withColumn("id", F.col("id") + 1_000_000)
    produce_micro_batches(a, f"{base}/in_a", f"{base}/tr", [F.col("id")], "constant", 100)
    run_scoring_stream(spark, f"{base}/in_a", model, f"{base}/tr", f"{base}/ck_a", timeout_s=300)
    produce_micro_batches(b, f"{base}/in_b", f"{base}/tr", [F.col("id")], "constant", 100)
    view = tracker_view(spark, f"{base}/tr")
    assert view.agg(F.sum("batch_size")).first()[0] == data.count()


def test_batch_identity_falls_back_to_epoch_and_skips_empty(spark):
    import json
    import os

    base = scratch_path(spark, "t-ident").removeprefix("file:")
    os.makedirs(f"{base}/in")
    vec = [0.1] * 64
    files = [
        [{"id": 1, "idx": 0, "data": vec, "label": 1}, {"id": 2, "idx": 0, "data": vec, "label": 2}],
        [],
        [{"id": 3, "idx": None, "data": vec, "label": 3}, {"id": 4, "idx": 7, "label": 3}],
    ]
    for i, recs in enumerate(files):
        with open(f"{base}/in/batch_{i}.json", "w") as f:
            json.dump(recs, f)
        os.utime(f"{base}/in/batch_{i}.json", (1_000 + i, 1_000 + i))
    model = train_centroids(testdata.labelled_arrays(spark, SF))
    run_scoring_stream(spark, f"{base}/in", model, f"{base}/tr", f"{base}/ck", timeout_s=300)
    res = spark.read.parquet(f"{base}/tr/results").select("batch_id", "epoch", "n").collect()
    got = sorted((r["batch_id"], r["epoch"], r["n"]) for r in res)
    # idx 0 and null fall back to the epoch id; the record without data is dropped;
    # the empty file's epoch writes nothing.
    assert [n for _, _, n in got] == [2, 1]
    assert all(b == e for b, e, _ in got)


def test_one_file_per_batch_without_adaptive_coalescing(spark):
    base = scratch_path(spark, "t-chunks")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        produce_micro_batches(testdata.labelled_arrays(spark, SF), f"{base}/in", f"{base}/tr", [F.col("id")], "constant", 100)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    files = spark.read.json(f"{base}/in", schema="idx long").groupBy("idx").agg(F.countDistinct("_metadata.file_path").alias("n"))
    assert {r["n"] for r in files.collect()} == {1}


def test_producer_rerun_replaces_its_trigger_rows(spark):
    base = scratch_path(spark, "t-rerun")
    data = testdata.labelled_arrays(spark, SF)
    for attempt in ("a", "b"):  # the second attempt re-runs the same producer
        produce_micro_batches(data, f"{base}/in_{attempt}", f"{base}/tr", [F.col("id")], "constant", 50,
                              producer="p1")
    view = tracker_view(spark, f"{base}/tr")
    assert view.agg(F.sum("batch_size")).first()[0] == data.count()


def test_stream_with_archive_option_completes(spark):
    base = scratch_path(spark, "t-archive")
    data = testdata.labelled_arrays(spark, SF)
    model = train_centroids(data)
    produce_micro_batches(data, f"{base}/in", f"{base}/tr", [F.col("id")], "constant", 100)
    run_scoring_stream(spark, f"{base}/in", model, f"{base}/tr", f"{base}/ck", archive_dir=f"{base}/archive",
                       timeout_s=300)
    # The archive may lag the end of an availableNow run; assert only on results.
    assert tracker_view(spark, f"{base}/tr").agg(F.sum("scored")).first()[0] == data.count()


def test_micro_batch_file_is_one_array_on_one_line(spark):
    import json
    base = scratch_path(spark, "t-array")
    data = testdata.labelled_arrays(spark, SF)
    produce_micro_batches(data, f"{base}/in", f"{base}/tr", [F.col("id")], "constant", 100)
    lines = spark.read.text(f"{base}/in").groupBy("batch_id").agg(F.collect_list("value").alias("lines")).collect()
    want = {k // 100 + 1: [] for k in range(data.count())}
    for r in data.orderBy("id").collect():
        want[r["id"] // 100 + 1].append(r["id"])
    for r in lines:
        records = json.loads(r["lines"][0])
        assert len(r["lines"]) == 1 and [x["id"] for x in records] == want[r["batch_id"]] and set(records[0]) == {"id", "idx", "data", "label"}


def test_pushes_run_beside_consumers_lose_no_row(spark):
    """Ten runs with a producer and two consumers at once: every consumer scores every row of every batch once."""
    data = testdata.labelled_arrays(spark, SF).filter("id < 60").cache()
    model = settled(train_centroids(data))
    for _ in range(10):
        base = scratch_path(spark, "t-live")
        run_live(spark, lambda b=base: push_micro_batches(data, f"{b}/in", f"{b}/tr", [F.col("id")], "constant", 10, per_push=3, producer="p"),
                 f"{base}/in", model, f"{base}/tr", {c: f"{base}/ck-{c}" for c in "ab"}, 4, timeout_s=120, producer="p")
        view = tracker_view(spark, f"{base}/tr", by_consumer=True).collect()
        assert sorted((r["consumer"], r["batch_id"], r["batch_size"], r["scored"]) for r in view) == [(c, k, 10, 10) for c in ("c_a", "c_b") for k in range(1, 7)]


def test_live_run_ends_with_the_error_of_a_part(spark):
    base = scratch_path(spark, "t-live")
    model = settled(train_centroids(testdata.labelled_arrays(spark, SF)))

    def produce():
        raise OSError("no space")
    with pytest.raises((OSError, TimeoutError)):
        run_live(spark, produce, f"{base}/in", model, f"{base}/tr", {"a": f"{base}/ck"}, timeout_s=3)


def test_identity_survives_new_checkpoints_and_any_files_per_trigger(spark):
    import json
    import os

    base = scratch_path(spark, "t-place").removeprefix("file:")
    os.makedirs(f"{base}/in")
    vec = [0.1] * 64
    for k in range(5):
        records = [] if k == 2 else [{"id": 10 * k + j, "idx": [0, None][j % 2], "data": vec, "label": 1} for j in range(k + 1)]
        with open(f"{base}/in/some file+{k}.json", "w") as f:
            json.dump(records, f)
        os.utime(f"{base}/in/some file+{k}.json", (1_000 + k, 1_000 + k))
    model = settled(train_centroids(testdata.labelled_arrays(spark, SF)))
    for consumer, n in (("five", 5), ("one", 1), ("two", 2)):
        run_scoring_stream(spark, f"{base}/in", model, f"{base}/tr", f"{base}/ck-{consumer}", n, consumer=consumer, identity="file", producer="p")
    got = spark.read.parquet(f"{base}/tr/results").select("consumer", "batch_id", "n").collect()
    assert sorted(map(tuple, got)) == sorted((f"c_{c}", k, k + 1) for c in ("five", "one", "two") for k in (0, 1, 3, 4))
    places = read_log(spark, f"{base}/tr/files/name=n_p", IDENTITY).collect()
    assert sorted((r["place"], r["first_epoch"]) for r in places) == [(k, 0) for k in range(5)]
    # a later file gets the next place, an epoch replayed by hand adds nothing
    with open(f"{base}/in/late.json", "w") as f:
        json.dump([{"id": 99, "data": vec, "label": 1}], f)
    run_scoring_stream(spark, f"{base}/in", model, f"{base}/tr", f"{base}/ck-one", 1, consumer="one", identity="file", producer="p")
    again = register_files(spark, f"{base}/tr", "p", f"{base}/ck-one", 5)
    assert again.count() == 6 and again.agg(F.max("place"), F.max("first_epoch")).first() == (5, 5)


def test_archive_and_input_hold_each_consumed_file_once(spark):
    base = scratch_path(spark, "t-reconcile")
    data = testdata.labelled_arrays(spark, SF)
    model = settled(train_centroids(data))
    produce_micro_batches(data.filter("id < 250"), f"{base}/in", f"{base}/tr", [F.col("id")], "constant", 50, producer="a")
    run = lambda: run_scoring_stream(spark, f"{base}/in", model, f"{base}/tr", f"{base}/ck", archive_dir=f"{base}/archive", producer="a")
    run()
    first = reconcile(spark, f"{base}/ck", f"{base}/in", f"{base}/archive").collect()
    assert len(first) == 5 and {r["state"] for r in first} <= {"input", "archive"}
    spark.createDataFrame([("[]",)], "value string").coalesce(1).write.text(f"{base}/in/batch_id=9")
    waiting = reconcile(spark, f"{base}/ck", f"{base}/in", f"{base}/archive").where("state = 'waiting'").collect()
    assert len(waiting) == 1 and waiting[0]["epoch"] is None
    run()
    second = reconcile(spark, f"{base}/ck", f"{base}/in", f"{base}/archive").collect()
    assert len(second) == 6 and {r["state"] for r in second} <= {"input", "archive"} and sum(r["state"] == "archive" for r in second) >= 1
    view = tracker_view(spark, f"{base}/tr").collect()
    assert sum(r["scored"] for r in view) == 250 and all(r["scored"] == r["batch_size"] for r in view)
    # a file that vanishes, and one that nobody took, are told apart
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(base).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = next(r["file"] for r in second if r["state"] == "archive")
    fs.rename(hadoop(f"{base}/archive{gone}"), hadoop(f"{base}/archive/stray"))
    states = {r["file"]: r["state"] for r in reconcile(spark, f"{base}/ck", f"{base}/in", f"{base}/archive").collect()}
    assert states[gone] == "lost" and states["/stray"] == "unlogged"


def test_records_are_accepted_or_rejected_with_a_reason(spark):
    good = '{"id": 1, "idx": 2, "data": [1, 2.5], "label": 3}'
    lines = [f"[{good}, {good}]", good, "  ", "[]", f"[{good}, {{", "42", "null", '"text"', f"[{good}, 7, null]", '{"id": 2, "label": 1}', '{"data": [1], "label": null}',
             '{"data": [1, null], "label": 1}', '{"data": "x", "label": 1}', '{"data": [1], "label": "many"}', '{"data": [], "label": 0, "extra": {"a": [1]}}', None]
    got = parse_records(spark.createDataFrame([(x, "f") for x in lines], "value string, file string")).collect()
    from collections import Counter
    assert Counter(r["reason"] for r in got) == {None: 5, "broken array": 1, "malformed": 7, "no data": 1, "no label": 1, "bad data": 1}
    assert all(r["data"] is not None and r["label"] is not None for r in got if r["reason"] is None)
    assert {r["raw"] for r in got if r["reason"] == "broken array"} == {f"[{good}, {{"}


def test_rejects_of_a_replayed_epoch_are_replaced(spark):
    base = scratch_path(spark, "t-rejects")
    lines = spark.createDataFrame([("{}", "f"), ("[1]", "g")], "value string, file string")
    for _ in range(2):
        write_rejects(parse_records(lines), f"{base}/tr", "c", 0)
    assert rejects(spark, f"{base}/tr").count() == 2 and rejects(spark, f"{base}/none").count() == 0


def test_trigger_log_has_a_row_for_each_trigger(spark):
    base = scratch_path(spark, "t-triggers")
    data = testdata.labelled_arrays(spark, SF)
    model = settled(train_centroids(data))
    produce_micro_batches(data, f"{base}/in", f"{base}/tr", [F.col("id")], "constant", 100)
    for _ in range(2):  # the second run has nothing to do and logs nothing
        run_scoring_stream(spark, f"{base}/in", model, f"{base}/tr", f"{base}/ck", 2, log_triggers=True)
    log = trigger_log(spark, f"{base}/tr").orderBy("epoch").collect()
    assert [(r["epoch"], r["rows"]) for r in log] == [(0, 200), (1, 200), (2, 100)] and all(r["ended"] >= r["started"] for r in log)


def test_stream_scores_with_models_beyond_the_bound(spark, monkeypatch):
    from scorelens.operators import centroid
    base = scratch_path(spark, "t-large")
    data = testdata.labelled_arrays(spark, SF)
    model = settled(train_centroids(data))
    produce_micro_batches(data, f"{base}/in", f"{base}/tr", [F.col("id")], "constant", 250)
    run_scoring_stream(spark, f"{base}/in", model, f"{base}/tr", f"{base}/ck", 2)
    small = tracker_view(spark, f"{base}/tr").select(*COLUMNS).collect()
    monkeypatch.setattr(centroid, "MAX_MODEL_VALUES", 100)
    monkeypatch.setattr(centroid, "PART_VALUES", 200)
    produce_micro_batches(data, f"{base}/in2", f"{base}/tr2", [F.col("id")], "constant", 250)
    run_scoring_stream(spark, f"{base}/in2", model, f"{base}/tr2", f"{base}/ck2", 2)
    assert sorted(tracker_view(spark, f"{base}/tr2").select(*COLUMNS).collect()) == sorted(small)
