"""Bootstrap bands, naive Bayes, sparse term vectors and training by epochs against direct computations."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelens.operators import bootstrap, naive_bayes, softmax, term_vectors
from scorelens.plans import reports
from scorelens.session import scratch_path
from scorelens.sources import dims


def test_poisson_weights_have_mean_and_variance_one(spark):
    draws = spark.range(1 << bootstrap.BITS).select(bootstrap.poisson_weight(F.col("id")).alias("w"))
    mean, var = draws.agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(mean - 1) < 1e-3 and abs(var - 1) < 2e-3


def bands(rows, replicates):
    """Per key: the replicates' means by hand."""
    out = defaultdict(lambda: [[0.0, 0.0] for _ in range(replicates)])
    for key, name, y in rows:
        for r in range(replicates):
            h = hashlib.md5(f":{name}:{r // 8}".encode()).hexdigest()
            half = int(h[:15] if r % 8 < 4 else h[15:30], 16)
            u = (half >> (bootstrap.BITS * (r % 4))) & ((1 << bootstrap.BITS) - 1)
            w = sum(u >= t for t in bootstrap.poisson_thresholds())
            if y is not None:
                out[key][r][0] += w
                out[key][r][1] += w * y
    return {k: [s / w for w, s in v if w] for k, v in out.items()}


def test_bootstrap_band_equals_direct_draws(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(k % 3 if k % 7 else None, f"r{k}", None if k % 11 == 0 else float(rng.normal())) for k in range(200)] + [(9, "one", 2.5), (8, "none", None)]
    df = spark.createDataFrame(rows, "k int, name string, y double")
    want = bands(rows, 50)
    for parts, salt_rows in ((1, 20_000), (7, 10)):  # neither partitioning nor splitting of large groups changes a figure
        monkeypatch.setattr(bootstrap, "SALT_ROWS", salt_rows)
        got = {r["k"]: r for r in bootstrap.bootstrap_band(df.repartition(parts), ["k"], ["y"], F.col("name"), 50).collect()}
        assert set(got) == {0, 1, 2, None, 9}
        for k, r in got.items():
            values = [y for key, _, y in rows if key == k and y is not None]
            low, high = np.percentile(want[k], [2.5, 97.5])
            assert r["n"] == len(values) and abs(r["mean"] - np.mean(values)) < 1e-8 and abs(r["ci_low"] - low) < 1e-8 and abs(r["ci_high"] - high) < 1e-8
        assert got[9]["ci_low"] == got[9]["ci_high"] == 2.5


def test_bootstrap_band_is_as_wide_as_resampling_makes_it(spark):
    rng = np.random.default_rng(1)
    y = rng.exponential(size=400)
    df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(y)], "k int, row long, y double")
    r = bootstrap.bootstrap_band(df, ["k"], ["y"], F.col("row"), 1000).first()
    low, high = np.percentile([rng.choice(y, len(y)).mean() for _ in range(1000)], [2.5, 97.5])
    assert abs(r["ci_low"] - low) < 0.25 * (high - low) and abs(r["ci_high"] - high) < 0.25 * (high - low)


def test_naive_bayes_equals_direct_counts(spark):
    train = [(1, "good good film", 1), (2, "bad film", 0), (3, "Good plot", 1), (4, None, 0), (5, "", 2), (6, "unlabelled good", None)]
    test = [(10, "good film"), (11, "bad bad plot good"), (12, "unknown words"), (13, None), (14, ""), (15, "good"), (15, "plot"), (None, "bad")]
    model = naive_bayes.train(spark.createDataFrame(train, "doc_id long, content string, label int"))
    got = {r["doc_id"]: r for r in naive_bayes.predict(spark.createDataFrame(test, "doc_id long, content string"), model).collect()}
    counts, texts = defaultdict(Counter), Counter(y for _, _, y in train if y is not None)
    for _, t, y in train:
        if y is not None:
            counts[y].update((t or "").lower().split())
    vocabulary = {w for c in counts.values() for w in c}
    for i, t in test[:5]:
        score = {y: math.log(texts[y] / 5) + sum(math.log((counts[y][w] + 1) / (sum(counts[y].values()) + len(vocabulary))) for w in (t or "").split() if w in vocabulary)
                 for y in texts}
        y = min(texts, key=lambda y: (-round(score[y], 9), y))
        assert got[i]["pred"] == y and abs(got[i]["score"] - score[y]) < 1e-8
    assert len(got) == 7 and got[15]["pred"] == 1  # rows that share an id are one text


def test_naive_bayes_joins_large_vocabularies_by_shuffle(spark, monkeypatch):
    from scorelens.operators import joins
    docs = spark.createDataFrame([(k, f"common w{k % 50} w{k % 7}", k % 2) for k in range(300)], "doc_id long, content string, label int")
    model = naive_bayes.train(docs)
    small = naive_bayes.predict(docs, model).collect()
    monkeypatch.setattr(joins.checked_broadcast, "__defaults__", (3,))
    assert sorted(naive_bayes.predict(docs, model).collect()) == sorted(small)


def test_sparse_vectors_score_as_dense_ones(spark):
    from scorelens.operators.centroid import predict_centroid
    texts = [(k, " ".join(f"w{(k * j) % 13}" for j in range(k % 9)) if k % 10 else None, k % 3) for k in range(60)]
    df = spark.createDataFrame(texts, "id long, content string, label int").withColumn("terms", F.coalesce(term_vectors.term_buckets("content", 32), F.array().cast("array<int>")))
    model = term_vectors.train_sparse_centroids(df, dims=32)
    sparse = {r["id"]: r["pred"] for r in term_vectors.predict_sparse(df, model).collect()}
    matrix = term_vectors.term_matrix(32)
    pdf = df.toPandas()
    dense = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(pdf["id"], matrix(pdf["terms"]), strict=True)], "id long, data array<double>")
    assert {r["id"]: r["pred"] for r in predict_centroid(dense, model).collect()} == sparse


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(3, 5))
    rows = [(k, [float(x) for x in centres[k % 3] + rng.normal(0, 0.8, 5)], k % 3) for k in range(240)] + [(900, None, 1), (901, [1.0] * 5, None), (902, [1.0] * 4, 1)]
    return spark.createDataFrame(rows, "id long, data array<double>, label int").cache(), rows[:240]


def numpy_epochs(rows, held_out, epochs, rate):
    x, y = np.array([[*r[1], 1.0] for r in rows]), np.array([r[2] for r in rows])
    ex, ey = np.array([[*r[1], 1.0] for r in held_out]), np.array([r[2] for r in held_out])
    w, out = np.zeros((3, 6)), []

    def p(x, w):
        z = np.exp(x @ w.T)
        return z / z.sum(1, keepdims=True)
    for _ in range(epochs):
        q = p(x, w)
        loss = -np.log(q[np.arange(len(y)), y]).mean()
        w = w - rate * (q - np.eye(3)[y]).T @ x / len(y)
        e = p(ex, w)
        out.append((loss, -np.log(e[np.arange(len(ey)), ey]).mean(), (e.argmax(1) == ey).mean()))
    return out, w


def test_epochs_equal_numpy_and_restart_where_they_stopped(spark, labelled):
    df, rows = labelled
    train, held_out = df.where("id < 180 or id >= 900"), df.where("id >= 180 and id < 900")
    want, w = numpy_epochs(rows[:180], rows[180:], 5, 0.5)
    straight = softmax.train_epochs(train, held_out, scratch_path(spark, "t-softmax"), 5, 0.5).orderBy("step").collect()
    assert [r["step"] for r in straight] == [1, 2, 3, 4, 5]
    for r, figures in zip(straight, want, strict=True):
        assert np.allclose((r["loss"], r["eval_loss"], r["eval_accuracy"]), figures, atol=1e-9) and r["train_rows"] == 180

    path = scratch_path(spark, "t-softmax")
    softmax.train_epochs(train, held_out, path, 2, 0.5)
    softmax._table(spark, ([0], [[9.0]])).write.parquet(f"{path}/epoch=3/model")  # epoch 3 broke off before its log
    assert softmax.last_epoch(spark, path, 5) == 2
    again = softmax.train_epochs(train, held_out, path, 5, 0.5)
    figures = ["step", "loss", "eval_loss", "eval_accuracy", "eval_f1", "eval_precision", "eval_recall"]
    assert np.allclose([[r[c] for c in figures] for r in again.orderBy("step").collect()], [[r[c] for c in figures] for r in straight], atol=1e-12)
    labels, weights = softmax._stored_model(spark, path, 5)
    assert labels == [0, 1, 2] and np.allclose(weights, w, atol=1e-9)

    best = softmax.best_epoch(again).first()
    assert (best["eval_accuracy"], -best["eval_loss"]) == max((r["eval_accuracy"], -r["eval_loss"]) for r in again.collect())
    predicted = softmax.predict(held_out, softmax.best_model(spark, path, again))
    assert abs(predicted.where("pred = label").count() / 60 - best["eval_accuracy"]) < 1e-12

    entries = softmax.trainer_entries(again, F.lit("run1"))
    runs = spark.createDataFrame([("run1", "softmax", "GPU", 0.0)], "run_id string, model string, env string, total_flos double")
    report = reports.training_report(runs, entries, dims.catalog(spark)).first()
    assert report["eval_step"] == 5 and report["train_runtime"] > 0 and report["missing_model"]


def test_epochs_need_rows(spark, labelled):
    with pytest.raises(ValueError):
        softmax.train_epochs(labelled[0].where("1 = 0"), labelled[0], scratch_path(spark, "t-softmax"), 1, 0.5)
