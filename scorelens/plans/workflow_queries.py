"""Composed workflows: charts over trainer logs and benchmarks, evaluation grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelens.operators import splits
from scorelens.operators.centroid import train_centroids
from scorelens.operators.term_vectors import DIMS
from scorelens.plans import evaluate, reports, testdata
from scorelens.plans.prepare_queries import TRAIN_PCT, TRAIN_PCT_TEXT, bucket_sql
from scorelens.plans.registry import ORACLES, query
from scorelens.plans.relational_queries import TRAINER_SQL, case_sql
from scorelens.plans.scoring_queries import HELD_OUT_SQL
from scorelens.plans.tracker_queries import bootstrap_sql
from scorelens.session import scratch_path
from scorelens.sources import dims, files, sinks

# The reference's evaluation grids (image and text batch sizes).
IMAGE_BATCH_SIZES = [1, 2, 5, 7, 10, 20, 30, 40]
TEXT_BATCH_SIZES = [1, 2, 5, 10, 20, 50]
BENCH_REPLICATES = 200
Z95 = "1.959963984540054"


def _band_sql(keys: str, value: str, source: str, digits: int = 9) -> str:
    d = digits
    return f"""
SELECT {keys}, count({value}) AS n, round(avg({value}), {d}) AS mean, round(stddev_samp({value}), {d}) AS stddev,
       round(avg({value}) - {Z95} * stddev_samp({value}) / sqrt(CAST(count({value}) AS DOUBLE)), {d}) AS ci_low,
       round(avg({value}) + {Z95} * stddev_samp({value}) / sqrt(CAST(count({value}) AS DOUBLE)), {d}) AS ci_high
FROM {source} GROUP BY {keys}"""


_MODELS_LIST = "[" + ", ".join(f"'{m}'" for m in testdata.BENCH_MODELS) + "]"
_ENV_CASE = "CASE l_returnflag " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in testdata.BENCH_ENVS.items()) + " END"
INFERENCE_SQL = f"""
WITH ir AS (
  SELECT {_MODELS_LIST}[CAST(l_partkey % {len(testdata.BENCH_MODELS)} + 1 AS INTEGER)] AS model, l_quantity AS duration,
         l_quantity * 10.0 AS total_images, CAST(l_linenumber AS DOUBLE) AS batch_size,
         l_tax AS average_batch_duration, {_ENV_CASE} AS env FROM lineitem),
irl AS (SELECT {case_sql('model', reports.IMAGE_MODEL_NAMES)} AS model, {case_sql('env', reports.ENV_NAMES)} AS env,
               batch_size, average_batch_duration, duration, total_images FROM ir)
"""


@query("batch_size_chart", INFERENCE_SQL + _band_sql(
    "batch_size, model, env", "average_batch_duration",
    f"(SELECT * FROM irl WHERE model IN ({', '.join(repr(v) for v in reports.IMAGE_MODEL_NAMES.values())}))"))
def batch_size_chart(spark, d):
    return reports.batch_size_chart(testdata.inference_results(spark, d))


@query("test_size_chart", INFERENCE_SQL + _band_sql("total_images AS test_size, env", "duration", "irl")
       .replace("GROUP BY total_images AS test_size, env", "GROUP BY total_images, env"))
def test_size_chart(spark, d):
    return reports.test_size_chart(testdata.inference_results(spark, d))


@query("batch_size_chart_bootstrap", INFERENCE_SQL.replace("env FROM lineitem)", "env, l_orderkey || '-' || l_linenumber AS row_key FROM lineitem)")
       .replace("duration, total_images FROM ir)", "duration, total_images, row_key FROM ir)") + bootstrap_sql(
    ["batch_size", "model", "env"], {"average_batch_duration": 9},
    f"(SELECT * FROM irl WHERE model IN ({', '.join(repr(v) for v in reports.IMAGE_MODEL_NAMES.values())}))", "row_key", BENCH_REPLICATES))
def batch_size_chart_bootstrap(spark, d):
    return reports.batch_size_bootstrap(testdata.inference_results(spark, d, keyed=True), BENCH_REPLICATES)


_TRAIN_NAMES_IN = ", ".join(repr(v) for v in reports.TRAIN_MODEL_NAMES.values())


@query("training_chart", TRAINER_SQL + f""",
rep AS (SELECT c.model, r.env, r.total_flos, tr.train_runtime, tr.train_samples_per_second, tr.train_steps_per_second
        FROM runs r LEFT JOIN {dims.catalog_sql()} ON r.position = c.position
        JOIN tr ON tr.run_id = r.run_id AND tr.rk = 1 JOIN ev ON ev.run_id = r.run_id AND ev.rk = 1),
f AS (SELECT {case_sql('model', reports.TRAIN_MODEL_NAMES)} AS model, {case_sql('env', reports.TRAIN_ENV_NAMES)} AS env,
             total_flos, train_runtime, train_samples_per_second, train_steps_per_second FROM rep
      WHERE {case_sql('model', reports.TRAIN_MODEL_NAMES)} IN ({_TRAIN_NAMES_IN})),
n AS (SELECT model, env, total_flos / (SELECT max(total_flos) FROM f) AS flos,
             train_runtime / (SELECT max(train_runtime) FROM f) AS runtime,
             train_samples_per_second / (SELECT max(train_samples_per_second) FROM f) AS batch_per_second,
             train_steps_per_second / (SELECT max(train_steps_per_second) FROM f) AS step_per_second FROM f)
SELECT env, category, model, round(avg(normalized_value), 9) AS mean
FROM (UNPIVOT n ON flos, runtime, batch_per_second, step_per_second INTO NAME category VALUE normalized_value)
GROUP BY env, category, model""")
def training_chart(spark, d):
    rep = testdata.training_report(spark, d)
    return reports.training_chart(rep)


@query("evaluate_arrays_grid", HELD_OUT_SQL + f"""
, a AS (SELECT label, count(*) AS n, 100.0 * avg(CAST(label = pred AS DOUBLE)) AS accuracy FROM pred GROUP BY label)
SELECT 'centroid' AS model, CAST(sum(n) AS BIGINT) AS total_images, b.batch_size, round(avg(accuracy), 3) AS balanced_accuracy,
       'spark' AS env
FROM a, (SELECT CAST(unnest({IMAGE_BATCH_SIZES}) AS INTEGER) AS batch_size) b GROUP BY b.batch_size""")
def evaluate_arrays_grid(spark, d):
    """Trained on the train split, scored on the test split; seconds differ by run and are left out."""
    data = splits.hash_split(testdata.labelled_arrays(spark, d), "id", TRAIN_PCT)
    model = train_centroids(data.filter(F.col("split") == "train"))
    result = evaluate.evaluate_arrays(data.filter(F.col("split") == "test"), model, dims.label_names(spark), IMAGE_BATCH_SIZES)
    return result.select("model", "total_images", "batch_size", "balanced_accuracy", "env")


WORDS_SQL = "list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')"


def text_centroid_sql(train_pct: int, dims: int = DIMS) -> str:
    """Prepared texts (shuffled, split), sparse term centroids of the train split, and every text's prediction."""
    return f"""
WITH lt AS (SELECT d.doc_id, l.toxic AS label, {bucket_sql('d.doc_id')} < {train_pct} AS train,
                   row_number() OVER (ORDER BY ('0x' || substr(md5('mix' || CAST(d.doc_id AS VARCHAR)), 1, 8))::BIGINT, d.doc_id) - 1 AS position,
                   {WORDS_SQL} AS w FROM documents d JOIN labels l USING (doc_id)),
tf AS (SELECT doc_id, label, train, {bucket_sql('word', dims)} AS bucket, count(*) AS n
       FROM (SELECT doc_id, label, train, unnest(w) AS word FROM lt) GROUP BY ALL),
n AS (SELECT label, count(*) AS texts FROM lt WHERE train GROUP BY label),
c AS (SELECT n.label AS cls, bucket, sum(tf.n) / CAST(any_value(texts) AS DOUBLE) AS v FROM tf JOIN n USING (label) WHERE train GROUP BY n.label, bucket),
h AS (SELECT n.label AS cls, 0.5 * coalesce(sum(v * v), 0.0) AS half FROM n LEFT JOIN c ON c.cls = n.label GROUP BY n.label),
d AS (SELECT doc_id, cls, sum(n * v) AS dot FROM tf JOIN c USING (bucket) GROUP BY doc_id, cls),
s AS (SELECT lt.doc_id, lt.label, train, position, h.cls, round(coalesce(dot, 0.0) - half, 9) AS score
      FROM lt CROSS JOIN h LEFT JOIN d ON d.doc_id = lt.doc_id AND d.cls = h.cls),
pred AS (SELECT doc_id, label, train, position, CAST(label = cls AS DOUBLE) AS hit FROM s
         QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, cls) = 1)
"""


@query("evaluate_texts_grid", text_centroid_sql(TRAIN_PCT_TEXT) + f"""
, t AS (SELECT hit, row_number() OVER (ORDER BY position) - 1 AS pos FROM pred WHERE NOT train),
b AS (SELECT g.batch_size, pos // g.batch_size AS batch_no, count(*) AS n, avg(hit) AS acc
      FROM t, (SELECT CAST(unnest({TEXT_BATCH_SIZES}) AS INTEGER) AS batch_size) g GROUP BY ALL)
SELECT 'centroid-terms' AS model, batch_size, CAST(sum(n) AS BIGINT) AS total_texts, count(*) AS batches, round(avg(acc), 9) AS accuracy FROM b GROUP BY batch_size""")
def evaluate_texts_grid(spark, d):
    """Without the seconds, which differ by run (``evaluate.evaluate_texts`` measures them)."""
    prepared = evaluate.prepare_text(testdata.labelled_text(spark, d), TRAIN_PCT_TEXT)
    return evaluate.evaluate_texts(prepared, TEXT_BATCH_SIZES, timed=False)


@query("score_text_batches", text_centroid_sql(TRAIN_PCT) + """
SELECT CAST(position // 10 AS BIGINT) AS batch_no, count(*) AS n, round(avg(hit), 9) AS accuracy FROM pred GROUP BY position // 10""")
def score_text_batches(spark, d):
    prepared = evaluate.prepare_text(testdata.labelled_text(spark, d), TRAIN_PCT)
    return evaluate.text_batch_scores(prepared, batch_size=10, timed=False)


@query("text_train_eval", f"""
WITH lt AS (SELECT d.doc_id, l.toxic AS label, {bucket_sql('d.doc_id', salt='s42')} < {TRAIN_PCT_TEXT} AS train, {WORDS_SQL} AS w
            FROM documents d JOIN labels l USING (doc_id)),
tf AS (SELECT doc_id, label, train, word, count(*) AS n FROM (SELECT doc_id, label, train, unnest(w) AS word FROM lt) GROUP BY ALL),
k AS (SELECT word, label AS cls, sum(n) AS n FROM tf WHERE train GROUP BY ALL),
cls AS (SELECT label AS cls, ln(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM lt WHERE train)) AS prior FROM lt WHERE train GROUP BY label),
t AS (SELECT cls, prior, ln(coalesce((SELECT sum(n) FROM k WHERE k.cls = cls.cls), 0) + (SELECT count(DISTINCT word) FROM k)) AS total FROM cls),
known AS (SELECT doc_id, sum(n) AS known FROM tf WHERE NOT train AND word IN (SELECT word FROM k) GROUP BY doc_id),
g AS (SELECT doc_id, cls, sum(tf.n * ln(k.n + 1.0::DOUBLE)) AS gain FROM tf JOIN k USING (word) WHERE NOT train GROUP BY doc_id, cls),
p AS (SELECT lt.label, t.cls AS pred FROM lt CROSS JOIN t LEFT JOIN known USING (doc_id) LEFT JOIN g ON g.doc_id = lt.doc_id AND g.cls = t.cls WHERE NOT train
      QUALIFY row_number() OVER (PARTITION BY lt.doc_id ORDER BY round(prior + coalesce(gain, 0.0) - coalesce(known, 0) * total, 9) DESC, t.cls) = 1),
c AS (SELECT count(*) AS n, sum(CAST(label = pred AS INTEGER)) AS hits, sum(CAST(label = 1 AND pred = 1 AS INTEGER)) AS tp,
             sum(CAST(label <> 1 AND pred = 1 AS INTEGER)) AS fp, sum(CAST(label = 1 AND pred <> 1 AS INTEGER)) AS fn FROM p),
r AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS pr, coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS rc FROM c)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(CAST(hits AS DOUBLE) / n, 9) AS accuracy,
       round(pr, 9) AS precision, round(rc, 9) AS recall, round(coalesce(2.0 * pr * rc / nullif(pr + rc, 0), 0.0), 9) AS f1 FROM r""")
def text_train_eval(spark, d):
    """Clean, split, count, fit, evaluate: naive Bayes on exact term counts."""
    return evaluate.text_bayes_eval(testdata.labelled_text(spark, d), TRAIN_PCT_TEXT, salt="s42")


@query("text_train_logistic")
def text_train_logistic(spark, d):
    """The same split with hashed term frequencies and logistic regression (an iterative fit, so rows only)."""
    return evaluate.text_pipeline_eval(testdata.labelled_text(spark, d), TRAIN_PCT_TEXT, salt="s42")


@query("consistency_check", """
WITH b AS (SELECT l_linestatus AS model, l_returnflag AS env, 100.0 - l_discount * 100.0 AS balanced_accuracy
           FROM lineitem),
v AS (SELECT model, min(round(balanced_accuracy, 3)) = max(round(balanced_accuracy, 3)) AS consistent
      FROM b GROUP BY model)
SELECT DISTINCT b.model, b.env AS environment, round(b.balanced_accuracy, 3) AS accuracy, v.consistent
FROM b JOIN v USING (model)""")
def consistency_check(spark, d):
    return reports.consistency_check(testdata.benchmark_rows(spark, d))


TRAINING_CSV = {"model": "string", "env": "string", "total_flos": "double", "train_runtime": "double",
                "train_samples_per_second": "double", "train_steps_per_second": "double"}


@query("training_chart_from_csv", ORACLES["training_chart"])
def training_chart_from_csv(spark, d):
    """The reference's chain: training report -> CSV -> read back as text ->
    numeric casts (numeric maxima, not text maxima) -> relabel, normalise, unpivot."""
    path = scratch_path(spark, "training-csv")
    rep = testdata.training_report(spark, d)
    sinks.write_csv(rep.select(*TRAINING_CSV), path)
    text = files.read_csv_text(spark, path)
    typed = text.select(*[F.col(c).cast(t).alias(c) for c, t in TRAINING_CSV.items()])
    return reports.training_chart(typed)
