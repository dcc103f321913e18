"""Model training, scoring and prediction metrics over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelens.functions.arrays import argmax, channel_to_pixel_major, wrap_uint8
from scorelens.operators import centroid, metrics, rows, softmax, splits
from scorelens.operators.generators import explode_batches
from scorelens.operators.scoring import predict_batch_column, score_batches_in_pandas
from scorelens.plans import testdata
from scorelens.plans.evaluate import grid_accuracy
from scorelens.plans.prepare_queries import CONSTANT_BATCH, TRAIN_PCT, bucket_sql
from scorelens.plans.registry import query, table
from scorelens.session import scratch_path


def predictions(spark, d):
    """Centroid model trained on all labelled arrays, scored on all of them."""
    data = testdata.labelled_arrays(spark, d)
    model = centroid.train_centroids(data)
    return centroid.predict_centroid(data, model).select(F.col("id").alias("vec_id"), "label", "pred")


CENTROID_SQL = """
WITH x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos,
                  CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
c AS (SELECT label AS cls, pos, avg(v) AS cv FROM x GROUP BY label, pos),
s AS (SELECT x.vec_id, c.cls, round(sum(x.v * c.cv) - 0.5 * sum(c.cv * c.cv), 9) AS score
      FROM x JOIN c USING (pos) GROUP BY x.vec_id, c.cls),
p AS (SELECT vec_id, cls, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cls) AS rk FROM s),
pred AS (SELECT e.vec_id, e.label, CAST(p.cls AS INTEGER) AS pred, p.score
         FROM embeddings e JOIN p ON p.vec_id = e.vec_id AND p.rk = 1)
"""

#: Trained on the train split, scored on the test split.
HELD_OUT_SQL = f"""
WITH x AS (SELECT vec_id, label, {bucket_sql('vec_id')} < {TRAIN_PCT} AS train,
                  generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
c AS (SELECT label AS cls, pos, avg(v) AS cv FROM x WHERE train GROUP BY label, pos),
s AS (SELECT x.vec_id, x.label, c.cls, round(sum(x.v * c.cv) - 0.5 * sum(c.cv * c.cv), 9) AS score
      FROM x JOIN c USING (pos) WHERE NOT train GROUP BY x.vec_id, x.label, c.cls),
pred AS (SELECT vec_id, label, CAST(cls AS INTEGER) AS pred FROM
         (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cls) AS rk FROM s) WHERE rk = 1)
"""

WEIGHTED_SQL = """
, pc AS (
  SELECT t.cls, t.support, t.tp, coalesce(m.predicted, 0) AS predicted FROM
    (SELECT label AS cls, count(*) AS support, sum(CAST(label = pred AS INTEGER)) AS tp FROM pred GROUP BY label) t
    LEFT JOIN (SELECT pred AS cls, count(*) AS predicted FROM pred GROUP BY pred) m USING (cls)),
pr AS (SELECT cls, support,
              coalesce(CAST(tp AS DOUBLE) / nullif(CAST(predicted AS DOUBLE), 0), 0.0) AS precision,
              coalesce(CAST(tp AS DOUBLE) / nullif(CAST(support AS DOUBLE), 0), 0.0) AS recall FROM pc),
f AS (SELECT *, coalesce(2.0 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM pr)
"""


@query("train_centroids", """
WITH x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS v
           FROM embeddings)
SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(v), 9) AS centroid FROM x GROUP BY label, pos""")
def train_centroids(spark, d):
    long = centroid.centroid_table(testdata.labelled_arrays(spark, d))
    return long.select("label", "pos", F.round("centroid", 9).alias("centroid"))


@query("predict_centroid", CENTROID_SQL + "SELECT vec_id, label, pred FROM pred")
def predict_centroid(spark, d):
    return predictions(spark, d)


@query("score_broadcast_params", CENTROID_SQL + "SELECT vec_id, pred, score FROM pred")
def score_broadcast_params(spark, d):
    data = testdata.labelled_arrays(spark, d)
    model = centroid.train_centroids(data)
    return centroid.predict_centroid(data, model, keep_score=True).select(
        F.col("id").alias("vec_id"), "pred", "score")


@query("score_batch_udf", CENTROID_SQL + "SELECT vec_id, label, pred FROM pred")
def score_batch_udf(spark, d):
    data = testdata.labelled_arrays(spark, d)
    model = centroid.train_centroids(data)
    return data.select(F.col("id").alias("vec_id"), "label", predict_batch_column(model).alias("pred"))


@query("score_map_in_pandas", CENTROID_SQL + f"""
SELECT vec_id AS id, (row_number() OVER (ORDER BY vec_id) - 1) // {CONSTANT_BATCH} AS batch_no, label, pred FROM pred""")
def score_map_in_pandas(spark, d):
    data = testdata.labelled_arrays(spark, d)
    model = centroid.train_centroids(data)
    batched = rows.assign_constant(data, [F.col("id")], CONSTANT_BATCH)
    return score_batches_in_pandas(batched, model).select("id", "batch_no", "label", "pred")  # seconds differ by run


@query("prediction_flags", CENTROID_SQL + "SELECT vec_id, label = pred AS correct FROM pred")
def prediction_flags(spark, d):
    p = predictions(spark, d)
    return p.select("vec_id", (F.col("label") == F.col("pred")).alias("correct"))


@query("overall_accuracy", CENTROID_SQL + """
SELECT avg(CAST(label = pred AS DOUBLE)) AS accuracy FROM pred""")
def overall_accuracy(spark, d):
    return metrics.overall_accuracy(predictions(spark, d))


@query("confusion_matrix", CENTROID_SQL + "SELECT label, pred, count(*) AS n FROM pred GROUP BY label, pred")
def confusion_matrix(spark, d):
    return metrics.confusion_counts(predictions(spark, d))


@query("metrics_weighted", CENTROID_SQL + WEIGHTED_SQL + """
SELECT round(sum(support * precision) / sum(support), 6) AS precision,
       round(sum(support * recall) / sum(support), 6) AS recall,
       round(sum(support * f1) / sum(support), 6) AS f1 FROM f""")
def metrics_weighted(spark, d):
    return metrics.weighted_metrics(predictions(spark, d))


@query("metrics_binary", """
WITH p AS (SELECT toxic AS label, 1 - quality AS pred FROM labels),
c AS (SELECT count(*) AS n, sum(CAST(label = pred AS INTEGER)) AS hits,
             sum(CAST(label = 1 AND pred = 1 AS INTEGER)) AS tp, sum(CAST(label <> 1 AND pred = 1 AS INTEGER)) AS fp,
             sum(CAST(label = 1 AND pred <> 1 AS INTEGER)) AS fn FROM p),
r AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS pr,
             coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS rc FROM c)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       round(CAST(hits AS DOUBLE) / n, 9) AS accuracy, round(pr, 9) AS precision, round(rc, 9) AS recall,
       round(coalesce(2.0 * pr * rc / nullif(pr + rc, 0), 0.0), 9) AS f1 FROM r""")
def metrics_binary(spark, d):
    lab = table(spark, d, "labels", "toxic", "quality")
    return metrics.binary_metrics(lab.select(F.col("toxic").alias("label"),
                                             (F.lit(1) - F.col("quality")).alias("pred")))


LINES_SQL = """
WITH lp AS (SELECT l_orderkey AS batch_no, l_returnflag AS class, CAST(l_discount > 0.05 AS DOUBLE) AS hit,
                   l_tax AS batch_duration FROM lineitem)
"""


@query("class_accuracy", LINES_SQL + """
SELECT class, count(*) AS n, round(100.0 * avg(hit), 9) AS accuracy, round(avg(batch_duration), 9) AS avg_batch_duration
FROM lp GROUP BY class""")
def class_accuracy(spark, d):
    pc = metrics.class_accuracy(testdata.line_predictions(spark, d))
    return pc.select("class", "n", F.round("accuracy", 9).alias("accuracy"),
                     F.round("avg_batch_duration", 9).alias("avg_batch_duration"))


@query("balanced_accuracy", LINES_SQL + """
SELECT round(avg(acc), 3) AS balanced_accuracy, round(avg(dur), 5) AS average_batch_duration
FROM (SELECT 100.0 * avg(hit) AS acc, avg(batch_duration) AS dur FROM lp GROUP BY class)""")
def balanced_accuracy(spark, d):
    pc = metrics.class_accuracy(testdata.line_predictions(spark, d))
    return pc.agg(F.round(F.avg("accuracy"), 3).alias("balanced_accuracy"),
                  F.round(F.avg("avg_batch_duration"), 5).alias("average_batch_duration"))


@query("class_mean_batch_duration", LINES_SQL + """
SELECT round(avg(dur), 5) AS average_batch_duration FROM (SELECT avg(batch_duration) AS dur FROM lp GROUP BY class)""")
def class_mean_batch_duration(spark, d):
    return metrics.class_mean_batch_duration(metrics.class_accuracy(testdata.line_predictions(spark, d)))


@query("micro_batch_accuracy", LINES_SQL + """
SELECT batch_no AS batch_id, count(*) AS batch_size, round(100.0 * avg(hit), 3) AS accuracy FROM lp GROUP BY batch_no""")
def micro_batch_accuracy(spark, d):
    lp = testdata.line_predictions(spark, d).withColumnRenamed("batch_no", "batch_id")
    return metrics.micro_batch_accuracy(lp)


@query("mean_of_batch_means", LINES_SQL + """
SELECT round(avg(m), 9) AS accuracy, count(*) AS n_batches FROM (SELECT avg(hit) AS m FROM lp GROUP BY batch_no)""")
def mean_of_batch_means(spark, d):
    r = metrics.mean_of_batch_means(testdata.line_predictions(spark, d))
    return r.select(F.round("accuracy", 9).alias("accuracy"), "n_batches")


@query("wall_time_per_batch", LINES_SQL + """
SELECT round(sum(d), 6) AS duration, count(*) AS n_batches, round(sum(d) / count(*), 9) AS average_batch_duration
FROM (SELECT max(batch_duration) AS d FROM lp GROUP BY batch_no)""")
def wall_time_per_batch(spark, d):
    r = metrics.wall_time_per_batch(testdata.line_predictions(spark, d))
    return r.select(F.round("duration", 6).alias("duration"), "n_batches",
                    F.round("average_batch_duration", 9).alias("average_batch_duration"))


PRED_BATCH = 64


@query("explode_batch_predictions", f"""
WITH n AS (SELECT l_returnflag AS class, l_discount > 0.05 AS correct, l_tax,
                  CAST((row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
                                           l_discount, l_tax) - 1) // {PRED_BATCH} AS BIGINT) AS batch_no
           FROM lineitem)
SELECT batch_no, class, correct, max(l_tax) OVER (PARTITION BY batch_no) AS batch_duration FROM n""")
def explode_batch_predictions(spark, d):
    lp = testdata.line_predictions(spark, d)
    order = [F.col(c) for c in ("batch_no", "l_linenumber", "l_partkey", "l_suppkey", "class", "l_discount",
                                "batch_duration")]
    # One row per fixed-size mini-batch, as a batch scorer returns it: item lists
    # plus one duration. Lists are bounded by the batch size.
    batched = rows.with_row_number(lp, order).withColumn("mb", rows.constant_batch(F.col("rn"), PRED_BATCH))
    items = F.array_sort(F.collect_list(F.struct("rn", "class", "correct")))
    per_batch = batched.groupBy("mb").agg(
        F.transform(items, lambda x: x["class"]).alias("classes"),
        F.transform(items, lambda x: x["correct"]).alias("hits"),
        F.max("batch_duration").alias("batch_duration"))
    out = explode_batches(per_batch, {"class": "classes", "correct": "hits"}, ["mb", "batch_duration"])
    return out.select(F.col("mb").alias("batch_no"), "class", "correct", "batch_duration")


BENCH_SQL = """
WITH b AS (SELECT l_linestatus AS model, CAST(l_linenumber AS DOUBLE) AS batch_size, l_returnflag AS env,
                  100.0 - l_discount * 100.0 AS balanced_accuracy FROM lineitem)
"""


@query("consistency_by_model", BENCH_SQL + """
SELECT DISTINCT model AS model_name, env AS environment, round(balanced_accuracy, 3) AS accuracy FROM b""")
def consistency_by_model(spark, d):
    return metrics.consistency_rows(testdata.benchmark_rows(spark, d), "model", "env", "balanced_accuracy",
                                    key_name="model_name")


@query("consistency_by_test_size", BENCH_SQL + """
SELECT DISTINCT batch_size AS test_size, env AS environment, round(balanced_accuracy, 3) AS accuracy FROM b""")
def consistency_by_test_size(spark, d):
    return metrics.consistency_rows(testdata.benchmark_rows(spark, d), "batch_size", "env", "balanced_accuracy",
                                    key_name="test_size")


@query("consistency_verdict", BENCH_SQL + """
SELECT env, count(*) AS n, count(DISTINCT round(balanced_accuracy, 3)) AS n_values,
       min(round(balanced_accuracy, 3)) = max(round(balanced_accuracy, 3)) AS consistent FROM b GROUP BY env""")
def consistency_verdict(spark, d):
    return metrics.consistency_verdict(testdata.benchmark_rows(spark, d), "env", "balanced_accuracy")


@query("array_channel_transpose", """
SELECT vec_id, list_transform(range(0, len(embedding)),
         lambda i: CAST(embedding[CAST((i % 4) * (len(embedding) // 4) + i // 4 + 1 AS INTEGER)] AS DOUBLE)) AS pixels
FROM embeddings""")
def array_channel_transpose(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", channel_to_pixel_major("embedding", 4).alias("pixels"))


@query("array_argmax", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS top_dim FROM embeddings""")
def array_argmax(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", argmax("embedding").alias("top_dim"))


@query("array_wrap_uint8", """
SELECT vec_id, list_transform(embedding, lambda x: CAST(((CAST(trunc(CAST(x AS DOUBLE) * 1000.0) AS INTEGER) % 256) + 256) % 256 AS INTEGER))
       AS pixels FROM embeddings""")
def array_wrap_uint8(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    scaled = F.transform("embedding", lambda x: (x.cast("double") * F.lit(1000.0)).cast("int"))
    return e.select("vec_id", wrap_uint8(scaled).alias("pixels"))


@query("select_best_run", f"""
WITH g AS (SELECT * FROM (VALUES (50), (70), (90), (98)) AS g(pct)),
x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS v,
             {bucket_sql('vec_id', salt='grid')} AS bucket FROM embeddings),
c AS (SELECT pct, label AS cls, pos, avg(v) AS cv FROM x JOIN g ON x.bucket < g.pct GROUP BY pct, label, pos),
s AS (SELECT g.pct, x.vec_id, x.label, c.cls, round(sum(x.v * c.cv) - 0.5 * sum(c.cv * c.cv), 9) AS score
      FROM x JOIN g ON x.bucket >= g.pct JOIN c ON c.pct = g.pct AND c.pos = x.pos
      GROUP BY g.pct, x.vec_id, x.label, c.cls),
p AS (SELECT pct, vec_id, label, cls, row_number() OVER (PARTITION BY pct, vec_id ORDER BY score DESC, cls) AS rk FROM s),
a AS (SELECT 'centroid_' || CAST(pct AS VARCHAR) AS run, avg(CAST(label = cls AS DOUBLE)) AS accuracy, count(*) AS n
      FROM p WHERE rk = 1 GROUP BY pct)
SELECT arg_max(run, (accuracy, run)) AS best_run, round(max(accuracy), 9) AS accuracy, CAST(count(*) AS BIGINT) AS runs FROM a""")
def select_best_run(spark, d):
    runs = grid_accuracy(testdata.labelled_arrays(spark, d), [50, 70, 90, 98], salt="grid")
    best = F.max(F.struct("accuracy", "run"))
    return runs.agg(best["run"].alias("best_run"), F.round(best["accuracy"], 9).alias("accuracy"),
                    F.count(F.lit(1)).alias("runs"))


@query("consistency_detail", BENCH_SQL + """
SELECT DISTINCT model AS model_name, env AS environment, round(balanced_accuracy, 3) AS accuracy FROM b""")
def consistency_detail(spark, d):
    """The reference's grouped form: per key a set of (env, rounded value) pairs,
    re-exploded. A set holds distinct pairs only, so it is bounded by the number
    of environments times the distinct rounded values, not by the rows."""
    return metrics.consistency_sets(testdata.benchmark_rows(spark, d), "model", "env", "balanced_accuracy",
                                    key_name="model_name")


# Training by epochs: fixed values of the registered run.
EPOCHS, RATE, EPOCH_TRAIN_PCT = 4, 8.0, 70


def epochs_sql() -> str:
    """The same epochs as a chain of tables: scores with weights w0, w1, ..., and a step between each and the next."""
    parts = [f"""
WITH e AS (SELECT vec_id, label, {bucket_sql('vec_id')} < {EPOCH_TRAIN_PCT} AS train, embedding FROM embeddings),
x AS (SELECT vec_id, label, train, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM e
      UNION ALL SELECT vec_id, label, train, 0, 1.0 FROM e),
w0 AS (SELECT cls, pos, 0.0::DOUBLE AS w FROM (SELECT DISTINCT label AS cls FROM e WHERE train), (SELECT DISTINCT pos FROM x))"""]
    for k in range(EPOCHS + 1):
        parts.append(f"""
z{k} AS (SELECT vec_id, label, train, cls, sum(v * w) AS z FROM x JOIN w{k} USING (pos) GROUP BY vec_id, label, train, cls),
n{k} AS (SELECT *, max(z) OVER r + ln(sum(exp(z)) OVER r / exp(max(z) OVER r)) AS norm FROM z{k} WINDOW r AS (PARTITION BY vec_id))""")
        if k < EPOCHS:
            parts.append(f"""
w{k + 1} AS (SELECT w.cls, w.pos, w.w - {RATE}::DOUBLE * g.g / (SELECT count(*) FROM e WHERE train) AS w FROM w{k} w JOIN
       (SELECT n.cls, x.pos, sum((exp(z - norm) - CAST(n.label = n.cls AS DOUBLE)) * x.v) AS g FROM n{k} n JOIN x USING (vec_id) WHERE n.train GROUP BY n.cls, x.pos) g
       ON g.cls = w.cls AND g.pos = w.pos)""")
    runs = []
    for k in range(1, EPOCHS + 1):
        parts.append(f"""
p{k} AS (SELECT label, cls AS pred FROM n{k} WHERE NOT train QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(z, 9) DESC, cls) = 1),
m{k} AS (SELECT t.cls, t.support, t.tp / CAST(t.support AS DOUBLE) AS rc, coalesce(t.tp / nullif(CAST(q.predicted AS DOUBLE), 0), 0.0) AS pr FROM
  (SELECT label AS cls, count(*) AS support, sum(CAST(label = pred AS INTEGER)) AS tp FROM p{k} GROUP BY label) t
  LEFT JOIN (SELECT pred AS cls, count(*) AS predicted FROM p{k} GROUP BY pred) q USING (cls)),
l{k} AS (SELECT {float(k)}::DOUBLE AS step, (SELECT avg(norm - z) FROM n{k - 1} WHERE train AND label = cls) AS loss,
              (SELECT avg(norm - z) FROM n{k} WHERE NOT train AND label = cls) AS eval_loss,
              (SELECT avg(CAST(label = pred AS DOUBLE)) FROM p{k}) AS eval_accuracy,
              sum(support * pr) / sum(support) AS eval_precision, sum(support * rc) / sum(support) AS eval_recall,
              sum(support * coalesce(2.0 * pr * rc / nullif(pr + rc, 0), 0.0)) / sum(support) AS eval_f1 FROM m{k})""")
        runs.append(f"SELECT * FROM l{k}")
    return ",".join(parts) + ", log AS (" + " UNION ALL ".join(runs) + """)
SELECT step, round(loss, 6) AS loss, round(eval_loss, 6) AS eval_loss, round(eval_accuracy, 6) AS eval_accuracy, round(eval_precision, 6) AS eval_precision,
       round(eval_recall, 6) AS eval_recall, round(eval_f1, 6) AS eval_f1, row_number() OVER (ORDER BY eval_accuracy DESC, eval_loss, step) = 1 AS best FROM log"""


@query("train_softmax_epochs", epochs_sql())
def train_softmax_epochs(spark, d):
    """Full-batch epochs with the model and a log row stored after each; the best epoch is marked (seconds differ by run)."""
    data = splits.hash_split(testdata.labelled_arrays(spark, d), "id", EPOCH_TRAIN_PCT)
    log = softmax.train_epochs(data.filter(F.col("split") == "train"), data.filter(F.col("split") == "test"), scratch_path(spark, "softmax"), EPOCHS, RATE)
    best = softmax.best_epoch(log).select("step")
    figures = ["loss", "eval_loss", "eval_accuracy", "eval_precision", "eval_recall", "eval_f1"]
    return log.select("step", *[F.round(c, 6).alias(c) for c in figures], (F.col("step") == best.scalar()).alias("best"))
