"""Exact order statistics of large columns: counts by bins, narrowed until one value is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1024


def order_statistics(rows: DataFrame, wanted: dict[int, list[int]]) -> dict[tuple[int, int], float]:
    """The values at the ``wanted`` ranks (from 0, name -> ranks below the name's count) of ``rows`` (name int, value double), all finite.

    Each round counts the values of every rank's range in BINS equal bins and goes on with the bin that holds the
    rank, so at most BINS rows a rank reach the driver, whatever the number of rows.
    """
    ends = {r["name"]: (r["low"], r["high"]) for r in rows.groupBy("name").agg(F.min("value").alias("low"), F.max("value").alias("high")).collect()}
    found = {(name, rank): (*ends[name], 0) for name, ranks in wanted.items() for rank in ranks}  # least and largest value left, how many lie before
    while left := [(name, rank, low, high) for (name, rank), (low, high, _) in found.items() if low < high]:
        ranges = rows.sparkSession.createDataFrame([(n, r, lo, hi) for n, r, lo, hi in left], "name int, rank long, low double, high double")
        held = rows.join(F.broadcast(ranges), "name").where(F.col("value").between(F.col("low"), F.col("high")))  # a row a rank
        at = F.least(F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1))
        counted = held.groupBy("name", "rank", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        passed: dict[tuple[int, int], bool] = {}
        for r in sorted(counted.collect(), key=lambda r: r["bin"]):
            key = r["name"], r["rank"]
            if passed.get(key):
                continue
            before = found[key][2]
            passed[key] = before + r["n"] > r["rank"]
            found[key] = (r["low"], r["high"], before) if passed[key] else (*found[key][:2], before + r["n"])
    return {key: low for key, (low, _, _) in found.items()}
