"""Stream tracker queries (flagship slice): tracker view, latency, throughput, report."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelens.functions.times import epoch_seconds, epoch_to_timestamp, placeholder_zero
from scorelens.operators.bootstrap import PER_BLOCK, draws_sql
from scorelens.operators.joins import upsert_by_key
from scorelens.plans import reports, testdata
from scorelens.plans.registry import query, table

# Fixed value: the plot library's number of bootstrap replicates.
REPLICATES = 1000

TRACKER_SQL = """
WITH ev AS (
  SELECT l_orderkey AS batch_id, CAST(sum(l_quantity) AS BIGINT) AS batch_size,
         epoch_us(min(l_shipdate)) / 1e6 AS start, epoch_us(max(l_shipdate)) / 1e6 AS "end",
         round(100.0 * avg(CAST(l_discount > 0.05 AS DOUBLE)), 3) AS accuracy
  FROM lineitem GROUP BY l_orderkey),
tracker AS (
  SELECT o_orderkey AS batch_id, o_orderpriority AS model, o_orderstatus AS env,
         coalesce(ev.batch_size, CAST(0 AS BIGINT)) AS batch_size, epoch_us(o_orderdate) / 1e6 AS triggered,
         coalesce(ev.start, 0.0::DOUBLE) AS start, coalesce(ev."end", 0.0::DOUBLE) AS "end",
         coalesce(ev.accuracy, 0.0::DOUBLE) AS accuracy
  FROM orders LEFT JOIN ev ON o_orderkey = ev.batch_id),
metrics AS (
  SELECT *, "end" > 0 AS completed,
         round(CASE WHEN "end" > 0 THEN start - triggered END, {d}) AS latency,
         round(CASE WHEN "end" > 0 THEN CAST(batch_size AS DOUBLE) / nullif("end" - start, 0) END, {d}) AS throughput,
         CASE WHEN "end" > 0 THEN start - triggered END < 0 AS clock_skew
  FROM tracker)
"""


def tracker_sql(digits: int = 9) -> str:
    return TRACKER_SQL.replace("{d}", str(digits))


@query("stream_tracker_view", tracker_sql() + """
SELECT batch_id, model, env, batch_size, triggered, start, "end", accuracy FROM tracker""")
def stream_tracker_view(spark, d):
    return testdata.tracker(spark, d)


@query("stream_latency", tracker_sql() + """
SELECT batch_id, latency, clock_skew FROM metrics""")
def stream_latency(spark, d):
    return reports.stream_metrics(testdata.tracker(spark, d)).select("batch_id", "latency", "clock_skew")


@query("stream_throughput", tracker_sql() + """
SELECT batch_id, batch_size, throughput FROM metrics""")
def stream_throughput(spark, d):
    return reports.stream_metrics(testdata.tracker(spark, d)).select("batch_id", "batch_size", "throughput")


@query("stream_report", tracker_sql(12) + """
SELECT model, env, count(*) AS batches, CAST(sum(batch_size) AS BIGINT) AS images,
       round(avg(latency), 6) AS mean_latency, round(max(latency), 6) AS max_latency,
       round(avg(throughput), 6) AS mean_throughput, round(max(throughput), 6) AS max_throughput,
       count(*) FILTER (WHERE throughput IS NULL) AS zero_spans,
       count(*) FILTER (WHERE clock_skew) AS clock_skews,
       round(avg(accuracy), 6) AS mean_accuracy
FROM metrics WHERE completed GROUP BY model, env ORDER BY model, env""")
def stream_report(spark, d):
    return reports.stream_report(testdata.tracker(spark, d))


@query("chart_line_mean_ci", tracker_sql(12) + """
SELECT batch_size AS images, model, env, count(latency) AS n,
       round(avg(latency), 2) AS mean, round(stddev_samp(latency), 2) AS stddev,
       round(avg(latency) - 1.959963984540054 * stddev_samp(latency) / sqrt(CAST(count(latency) AS DOUBLE)), 2) AS ci_low,
       round(avg(latency) + 1.959963984540054 * stddev_samp(latency) / sqrt(CAST(count(latency) AS DOUBLE)), 2) AS ci_high
FROM metrics WHERE completed GROUP BY batch_size, model, env""")
def chart_line_mean_ci(spark, d):
    return reports.stream_line_chart(testdata.tracker(spark, d), "latency", digits=2)


def bootstrap_sql(keys: list[str], values: dict[str, int], source: str, row: str, replicates: int) -> str:
    """Bootstrap bands of ``values`` (name: digits) per ``keys``, from the same md5 draws."""
    k = ", ".join(keys)
    replicate_sums = ", ".join(f"sum(CASE WHEN {v} IS NOT NULL THEN w END) AS {v}_w, sum(w * {v}) AS {v}_s" for v in values)
    bands = "\nUNION ALL ".join(f"""
SELECT {k}, '{v}' AS metric, n_{v} AS n, round(mean_{v}, {d}) AS mean, round(low_{v}, {d}) AS ci_low, round(high_{v}, {d}) AS ci_high
FROM plain JOIN band USING ({k}) WHERE n_{v} > 0""" for v, d in values.items())
    ends = ", ".join(f"quantile_cont({v}_s / {v}_w, 0.025) FILTER (WHERE {v}_w > 0) AS low_{v}, quantile_cont({v}_s / {v}_w, 0.975) FILTER (WHERE {v}_w > 0) AS high_{v}"
                     for v in values)
    return f"""
, src AS (SELECT {k}, {', '.join(values)}, CAST({row} AS VARCHAR) AS row_key FROM {source}),
drawn AS (SELECT *, {draws_sql("md5(':' || row_key || ':' || block)")} AS ws FROM src, range({-(-replicates // PER_BLOCK)}) t(block)),
weighted AS (SELECT {k}, {', '.join(values)}, block * {PER_BLOCK} + i AS replicate, CAST(ws[i + 1] AS DOUBLE) AS w FROM drawn, range({PER_BLOCK}) u(i)),
sums AS (SELECT {k}, replicate, {replicate_sums} FROM weighted WHERE replicate < {replicates} GROUP BY {k}, replicate),
band AS (SELECT {k}, {ends} FROM sums GROUP BY {k}),
plain AS (SELECT {k}, {', '.join(f'count({v}) AS n_{v}, avg({v}) AS mean_{v}' for v in values)} FROM src GROUP BY {k})
{bands}"""


@query("chart_line_bootstrap", tracker_sql(12) + bootstrap_sql(
    ["images", "model", "env"], {"latency": 3, "throughput": 9}, "(SELECT *, batch_size AS images FROM metrics WHERE completed)", "batch_id", REPLICATES))
def chart_line_bootstrap(spark, d):
    """Latency and throughput lines with the plot's kind of band: percentiles of bootstrapped means."""
    return reports.stream_line_bootstrap(testdata.tracker(spark, d), REPLICATES)


@query("cast_epoch_timestamp", tracker_sql() + """
SELECT batch_id, make_timestamp(CAST(round(triggered * 1e6) AS BIGINT)) AS triggered_time,
       make_timestamp(CAST(round(start * 1e6) AS BIGINT)) AS start_time
FROM tracker""")
def cast_epoch_timestamp(spark, d):
    t = testdata.tracker(spark, d)
    return t.select("batch_id", epoch_to_timestamp("triggered").alias("triggered_time"),
                    epoch_to_timestamp("start").alias("start_time"))


@query("placeholder_missing", tracker_sql() + """
SELECT batch_id, CASE WHEN CAST(trunc("end" - start) AS BIGINT) = 0 THEN '-'
                      ELSE CAST(CAST(trunc("end" - start) AS BIGINT) AS VARCHAR) END AS span
FROM tracker""")
def placeholder_missing(spark, d):
    t = testdata.tracker(spark, d)
    span = (F.col("end") - F.col("start")).cast("bigint")
    return t.select("batch_id", placeholder_zero(span).alias("span"))


@query("upsert_by_key", """
WITH upd AS (
  SELECT l_orderkey AS batch_id, epoch_us(min(l_shipdate)) / 1e6 AS start,
         epoch_us(max(l_shipdate)) / 1e6 AS "end", CAST(count(*) AS DOUBLE) AS accuracy
  FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey)
SELECT o_orderkey AS batch_id, coalesce(upd.start, 0.0::DOUBLE) AS start,
       coalesce(upd."end", 0.0::DOUBLE) AS "end", coalesce(upd.accuracy, 0.0::DOUBLE) AS accuracy
FROM orders LEFT JOIN upd ON o_orderkey = upd.batch_id""")
def upsert_by_key_q(spark, d):
    base = table(spark, d, "orders", "o_orderkey").select(
        F.col("o_orderkey").alias("batch_id"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"),
        F.lit(0.0).alias("accuracy"))
    li = table(spark, d, "lineitem", "l_orderkey", "l_shipdate", "l_linestatus")
    updates = li.filter(F.col("l_linestatus") == "F").groupBy(F.col("l_orderkey").alias("batch_id")).agg(
        epoch_seconds(F.min("l_shipdate")).alias("start"), epoch_seconds(F.max("l_shipdate")).alias("end"),
        F.count(F.lit(1)).cast("double").alias("accuracy"))
    return upsert_by_key(base, updates, "batch_id", ["start", "end", "accuracy"])
