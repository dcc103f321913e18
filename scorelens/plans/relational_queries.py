"""Projections, relabels, filters, joins, set operations, sorts and dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelens.functions.text import inner_path, path_part, with_unit
from scorelens.operators import splits
from scorelens.operators.joins import lookup
from scorelens.operators.latest import latest_per_group
from scorelens.operators.metrics import mean_by
from scorelens.operators.relabel import normalise_by_max, relabel, unpivot
from scorelens.plans import testdata
from scorelens.plans.registry import query, table
from scorelens.sources import dims

# Relabel maps exercised on the order table (four named, rest unchanged).
PRIORITY_NAMES = {"1-URGENT": "Urgent", "2-HIGH": "High", "3-MEDIUM": "Medium", "4-NOT SPECIFIED": "Unspecified"}
STATUS_NAMES = {"F": "FINISHED", "O": "OPEN"}


def case_sql(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} ELSE {col} END"


@query("project_rename", """
SELECT l_orderkey AS batch_id, l_linenumber AS step, l_quantity AS images, l_returnflag AS env FROM lineitem""")
def project_rename(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("step"),
                     F.col("l_quantity").alias("images"), F.col("l_returnflag").alias("env"))


@query("project_struct_fields", """
SELECT l_orderkey AS run_id, CAST(l_linenumber AS DOUBLE) AS step, l_tax AS eval_loss FROM lineitem""")
def project_struct_fields(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_tax")
    nested = li.select("l_orderkey", F.struct(F.col("l_linenumber").cast("double").alias("step"),
                                              F.col("l_tax").alias("eval_loss")).alias("log"))
    return nested.select(F.col("l_orderkey").alias("run_id"), "log.step", "log.eval_loss")


@query("project_constants", """
SELECT o_orderkey AS run_id, 'google/vit-base-patch16-224' AS model, 'GPU' AS env,
       '86.568M' AS params, '330.229MB' AS size FROM orders""")
def project_constants(spark, d):
    name, params, size = dims.CATALOG[9]
    o = table(spark, d, "orders", "o_orderkey")
    return o.select(F.col("o_orderkey").alias("run_id"), F.lit(name).alias("model"), F.lit("GPU").alias("env"),
                    with_unit(F.lit(params), "M").alias("params"), with_unit(F.lit(size), "MB").alias("size"))


@query("relabel_case_chain", f"""
SELECT o_orderkey, {case_sql('o_orderpriority', PRIORITY_NAMES)} AS model FROM orders""")
def relabel_case_chain(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    return o.select("o_orderkey", relabel("o_orderpriority", PRIORITY_NAMES).alias("model"))


@query("relabel_nested_case", f"""
SELECT o_orderkey, {case_sql('o_orderstatus', STATUS_NAMES)} AS env FROM orders""")
def relabel_nested_case(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    return o.select("o_orderkey", relabel("o_orderstatus", STATUS_NAMES).alias("env"))


@query("filter_in_list", f"""
SELECT o_orderkey, model FROM (SELECT o_orderkey, {case_sql('o_orderpriority', PRIORITY_NAMES)} AS model FROM orders)
WHERE model IN ({', '.join(repr(v) for v in PRIORITY_NAMES.values())})""")
def filter_in_list(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    r = o.select("o_orderkey", relabel("o_orderpriority", PRIORITY_NAMES).alias("model"))
    return r.filter(F.col("model").isin(list(PRIORITY_NAMES.values())))


@query("filter_not_null", """
SELECT l_orderkey AS run_id, CAST(l_linenumber AS DOUBLE) AS step, 1.0 - l_tax AS eval_accuracy
FROM lineitem WHERE l_returnflag <> 'R'""")
def filter_not_null(spark, d):
    e = testdata.trainer_log_entries(spark, d)
    return e.filter(F.col("eval_accuracy").isNotNull()).select("run_id", "step", "eval_accuracy")


@query("clean_labels_try_cast", """
SELECT event_id, label FROM (
  SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN event_type
                                 ELSE json_extract_string(props, '$.k') END AS INTEGER) AS label
  FROM events) WHERE label IS NOT NULL""")
def clean_labels_try_cast(spark, d):
    e = table(spark, d, "events", "event_id", "event_type", "props")
    raw = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(
        F.get_json_object("props", "$.k"))
    return e.select("event_id", raw.try_cast("int").alias("label")).filter(F.col("label").isNotNull())


@query("distinct_labels", """
SELECT DISTINCT TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS label FROM events""")
def distinct_labels(spark, d):
    e = table(spark, d, "events", "props")
    return e.select(F.get_json_object("props", "$.k").try_cast("int").alias("label")).distinct()


@query("string_path_normalise", """
SELECT page_id, CASE WHEN contains(url, 'https') THEN
         array_to_string(string_split(url, '/')[2:len(string_split(url, '/')) - 1], '/')
       ELSE url END AS model_path
FROM pages""")
def string_path_normalise(spark, d):
    p = table(spark, d, "pages", "page_id", "url")
    return p.select("page_id", F.when(F.col("url").contains("https"), inner_path("url"))
                    .otherwise(F.col("url")).alias("model_path"))


@query("string_split_parts", """
SELECT page_id, split_part(url, '/', 3) AS host, split_part(url, '/', 4) AS lang FROM pages""")
def string_split_parts(spark, d):
    p = table(spark, d, "pages", "page_id", "url")
    return p.select("page_id", path_part("url", 3).alias("host"), path_part("url", 4).alias("lang"))


@query("format_units", """
SELECT p_partkey, CAST(p_retailprice AS VARCHAR) || 'M' AS params,
       CAST(p_size AS VARCHAR) || 'MB' AS size FROM part""")
def format_units(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_retailprice", "p_size")
    return p.select("p_partkey", with_unit("p_retailprice", "M").alias("params"),
                    with_unit("p_size", "MB").alias("size"))


@query("project_feature_label", """
SELECT d.doc_id, d.text AS content, l.toxic AS label FROM documents d JOIN labels l USING (doc_id)""")
def project_feature_label(spark, d):
    return testdata.labelled_text(spark, d)


@query("join_broadcast_label", f"""
SELECT vec_id, e.label, n.name, n.name IS NULL AS missing
FROM embeddings e LEFT JOIN {dims.label_names_sql()} ON e.label = n.label""")
def join_broadcast_label(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "label")
    return lookup(e, dims.label_names(spark), "label").select("vec_id", "label", "name", "missing")


@query("dim_label_names", f"""
SELECT n.label, n.name, count(e.vec_id) AS n_vectors
FROM {dims.label_names_sql()} LEFT JOIN embeddings e ON e.label = n.label GROUP BY n.label, n.name""")
def dim_label_names(spark, d):
    counts = table(spark, d, "embeddings", "label").groupBy("label").agg(F.count(F.lit(1)).alias("n_vectors"))
    return dims.label_names(spark).join(counts, "label", "left").select(
        "label", "name", F.coalesce("n_vectors", F.lit(0).cast("bigint")).alias("n_vectors"))


@query("dim_catalog", f"""
SELECT c.model, c.params, c.size, count(o.o_orderkey) AS runs
FROM {dims.catalog_sql()} LEFT JOIN orders o ON CAST(o.o_custkey % 17 AS INTEGER) = c.position
GROUP BY c.model, c.params, c.size""")
def dim_catalog(spark, d):
    runs = testdata.trainer_runs(spark, d).groupBy("position").agg(F.count(F.lit(1)).alias("runs"))
    return dims.catalog(spark).join(runs, "position", "left").select(
        "model", "params", "size", F.coalesce("runs", F.lit(0).cast("bigint")).alias("runs"))


@query("join_broadcast_catalog", f"""
SELECT o_orderkey AS run_id, c.model, c.params, c.size, c.model IS NULL AS missing_model
FROM orders o LEFT JOIN {dims.catalog_sql()} ON CAST(o.o_custkey % 17 AS INTEGER) = c.position""")
def join_broadcast_catalog(spark, d):
    runs = testdata.trainer_runs(spark, d)
    facts = dims.catalog(spark).select("model", "params", "size")
    return lookup(runs, facts, "model", flag="missing_model").select(
        "run_id", "model", "params", "size", "missing_model")


@query("join_anti_split", """
SELECT doc_id FROM documents
WHERE ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 100 >= 98""")
def join_anti_split(spark, d):
    docs = table(spark, d, "documents", "doc_id")
    train = splits.train_part(docs, "doc_id", 98)
    return splits.rest_after(docs, train, "doc_id")


@query("union_all_position", """
SELECT l_linestatus AS model, l_quantity AS duration, l_returnflag AS env FROM lineitem WHERE l_linestatus = 'F'
UNION ALL
SELECT l_linestatus, l_quantity, l_returnflag FROM lineitem WHERE l_linestatus = 'O'""")
def union_all_position(spark, d):
    b = testdata.benchmark_rows(spark, d).select("model", "duration", "env")
    return b.filter(F.col("model") == "F").union(b.filter(F.col("model") == "O"))


@query("union_by_name", """
SELECT o_orderkey AS batch_id, epoch_us(o_orderdate) / 1e6 AS triggered, 0.0::DOUBLE AS start FROM orders
UNION ALL
SELECT l_orderkey AS batch_id, NULL::DOUBLE AS triggered, epoch_us(min(l_shipdate)) / 1e6 AS start
FROM lineitem GROUP BY l_orderkey""")
def union_by_name(spark, d):
    trig = testdata.tracker_triggers(spark, d).select("batch_id", "triggered", F.lit(0.0).alias("start"))
    res = testdata.tracker_events(spark, d).select("start", "batch_id")
    return trig.unionByName(res, allowMissingColumns=True)


@query("sort_by_key", """
SELECT o_orderpriority AS model, o_orderkey AS batch_id FROM orders ORDER BY model, batch_id""")
def sort_by_key(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    return o.select(F.col("o_orderpriority").alias("model"), F.col("o_orderkey").alias("batch_id")).orderBy(
        "model", "batch_id")


@query("top_k_desc", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1""")
def top_k_desc(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice")
    return o.orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")).limit(1)


@query("limit_first_n", """
SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 100""")
def limit_first_n(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "label")
    return e.orderBy("vec_id").limit(100)


@query("src_repartitioned_scan", """
SELECT label, count(*) AS n FROM embeddings GROUP BY label""")
def src_repartitioned_scan(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "label")
    # Fewer, larger scan tasks without a shuffle; the aggregate combines inside them.
    return e.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions"))).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"))


NORMALISE_SQL = """
WITH b AS (
  SELECT l_linestatus AS model, l_returnflag AS env, l_quantity AS runtime, l_extendedprice AS flos,
         l_discount AS step_per_second, l_tax AS batch_per_second FROM lineitem)
"""


@query("normalise_by_max", NORMALISE_SQL + """
SELECT model, env, round(runtime / (SELECT max(runtime) FROM b), 9) AS runtime,
       round(flos / (SELECT max(flos) FROM b), 9) AS flos,
       round(step_per_second / (SELECT max(step_per_second) FROM b), 9) AS step_per_second,
       round(batch_per_second / (SELECT max(batch_per_second) FROM b), 9) AS batch_per_second
FROM b""")
def normalise_by_max_q(spark, d):
    return normalise_by_max(_norm_input(spark, d), ["runtime", "flos", "step_per_second", "batch_per_second"], 9)


def _norm_input(spark, d):
    li = table(spark, d, "lineitem", "l_linestatus", "l_returnflag", "l_quantity", "l_extendedprice",
               "l_discount", "l_tax")
    return li.select(F.col("l_linestatus").alias("model"), F.col("l_returnflag").alias("env"),
                     F.col("l_quantity").alias("runtime"), F.col("l_extendedprice").alias("flos"),
                     F.col("l_discount").alias("step_per_second"), F.col("l_tax").alias("batch_per_second"))


@query("unpivot_metrics", """
UNPIVOT (SELECT l_linestatus AS model, l_returnflag AS env, l_quantity AS runtime, l_tax AS flos FROM lineitem)
ON runtime, flos INTO NAME category VALUE normalized_value""")
def unpivot_metrics(spark, d):
    li = table(spark, d, "lineitem", "l_linestatus", "l_returnflag", "l_quantity", "l_tax")
    wide = li.select(F.col("l_linestatus").alias("model"), F.col("l_returnflag").alias("env"),
                     F.col("l_quantity").alias("runtime"), F.col("l_tax").alias("flos"))
    return unpivot(wide, ["model", "env"])


@query("chart_bar_mean", NORMALISE_SQL + """
, n AS (
  SELECT model, env, runtime / (SELECT max(runtime) FROM b) AS runtime, flos / (SELECT max(flos) FROM b) AS flos
  FROM b)
SELECT category, model, env, round(avg(normalized_value), 9) AS mean
FROM (UNPIVOT n ON runtime, flos INTO NAME category VALUE normalized_value)
GROUP BY category, model, env""")
def chart_bar_mean(spark, d):
    wide = normalise_by_max(_norm_input(spark, d).select("model", "env", "runtime", "flos"), ["runtime", "flos"])
    return mean_by(unpivot(wide, ["model", "env"]), ["category", "model", "env"], "normalized_value")


@query("filter_env_panel", f"""
SELECT o_orderkey, {case_sql('o_orderstatus', STATUS_NAMES)} AS env, o_totalprice FROM orders
WHERE {case_sql('o_orderstatus', STATUS_NAMES)} IN ('FINISHED', 'OPEN')""")
def filter_env_panel(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    r = o.select("o_orderkey", relabel("o_orderstatus", STATUS_NAMES).alias("env"), "o_totalprice")
    return r.filter(F.col("env").isin("FINISHED", "OPEN"))


TRAINER_SQL = """
WITH runs AS (
  SELECT o_orderkey AS run_id, CAST(o_custkey % 17 AS INTEGER) AS position,
         CASE WHEN o_orderstatus IN ('O', 'P') THEN 'COLAB_GPU' ELSE 'GPU' END AS env,
         CAST(o_custkey % 4 * 8 + 8 AS INTEGER) AS train_batch_size, CAST(o_orderkey % 1000 AS INTEGER) AS global_step,
         o_totalprice AS total_flos FROM orders),
tr AS (
  SELECT l_orderkey AS run_id, l_quantity AS train_runtime, l_extendedprice AS train_samples_per_second,
         l_discount AS train_steps_per_second,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC,
                            l_quantity DESC, l_extendedprice DESC, l_discount DESC) AS rk
  FROM lineitem WHERE l_returnflag = 'R'),
ev AS (
  SELECT l_orderkey AS run_id, CAST(l_linenumber AS DOUBLE) AS eval_step, 1.0 - l_tax AS eval_accuracy,
         1.0 - l_discount AS eval_f1, l_tax AS eval_loss, l_quantity AS eval_runtime,
         1.0 - l_discount * 0.5 AS eval_precision, 1.0 - l_tax * 0.5 AS eval_recall,
         l_extendedprice AS eval_samples_per_second, l_discount AS eval_steps_per_second,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC,
                            1.0 - l_tax DESC, 1.0 - l_discount DESC, l_tax DESC, l_quantity DESC,
                            l_extendedprice DESC) AS rk
  FROM lineitem WHERE l_returnflag <> 'R')
"""


@query("training_report", TRAINER_SQL + f"""
SELECT r.run_id, c.model, r.env, CAST(c.params AS VARCHAR) || 'M' AS params, CAST(c.size AS VARCHAR) || 'MB' AS size,
       r.train_batch_size, r.global_step, r.total_flos, c.model IS NULL AS missing_model, tr.train_runtime,
       tr.train_samples_per_second, tr.train_steps_per_second, ev.eval_step, ev.eval_accuracy, ev.eval_f1, ev.eval_loss,
       ev.eval_precision, ev.eval_recall, ev.eval_runtime, ev.eval_samples_per_second, ev.eval_steps_per_second
FROM runs r LEFT JOIN {dims.catalog_sql()} ON r.position = c.position
JOIN tr ON tr.run_id = r.run_id AND tr.rk = 1
JOIN ev ON ev.run_id = r.run_id AND ev.rk = 1""")
def training_report(spark, d):
    return testdata.training_report(spark, d)


@query("latest_per_run", TRAINER_SQL + """
SELECT run_id, eval_step, eval_accuracy, eval_f1, eval_loss, eval_runtime FROM ev WHERE rk = 1""")
def latest_per_run(spark, d):
    cols = ["eval_accuracy", "eval_f1", "eval_loss", "eval_runtime"]
    e = testdata.trainer_log_entries(spark, d).filter(F.col("eval_accuracy").isNotNull())
    out = latest_per_group(e, ["run_id"], ["step", "l_partkey", "l_suppkey"] + cols, ["step"] + cols)
    return out.withColumnRenamed("step", "eval_step")


@query("join_inner_three_way", TRAINER_SQL + """
SELECT r.run_id, r.env, tr.train_runtime, ev.eval_accuracy
FROM runs r JOIN tr ON tr.run_id = r.run_id AND tr.rk = 1 JOIN ev ON ev.run_id = r.run_id AND ev.rk = 1""")
def join_inner_three_way(spark, d):
    rep = testdata.training_report(spark, d)
    return rep.select("run_id", "env", "train_runtime", "eval_accuracy")
