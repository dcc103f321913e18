"""Global order-based numbering and the batching schedules built on it.

A plain ``row_number() over (order by ...)`` runs in one task. Here the frame is
range-sorted across all partitions and checkpointed (stable partition ids, cut
lineage, survives executor loss); each partition's row count becomes an offset
(one row per partition, so the offset table is bounded by the partition count),
and a row's number is its partition offset plus its position in the partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelens.functions.hashing import md5_bucket, md5_int, md5_long
from scorelens.session import checkpoint_root

_LOCAL_BITS = 33  # monotonically_increasing_id: partition id in the upper 31 bits


def _sorted_checkpoint(df: DataFrame, order: list) -> DataFrame:
    checkpoint_root(df.sparkSession)
    return df.orderBy(*order).checkpoint(eager=True)


def with_row_number(df: DataFrame, order: list, name: str = "rn", start: int = 0) -> DataFrame:
    """Add a dense global position over a total order (``order`` must be unique)."""
    ranked = _sorted_checkpoint(df, order).withColumn("_mid", F.monotonically_increasing_id())
    part = F.shiftright(F.col("_mid"), _LOCAL_BITS)
    counts = ranked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset")
    )
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        ranked.join(F.broadcast(offsets), part == F.col("_part"))
        .withColumn(name, F.col("_offset") + local + F.lit(start))
        .drop("_mid", "_part", "_offset")
    )


def with_running_sum(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` over a total order, computed per partition
    plus a per-partition offset (no single-task window over the data)."""
    ranked = _sorted_checkpoint(df, order).withColumn(
        "_part", F.shiftright(F.monotonically_increasing_id(), _LOCAL_BITS)
    ).withColumn("_pos", F.monotonically_increasing_id())
    sums = ranked.groupBy("_part").agg(F.sum(value).alias("_s"))
    offsets = sums.select(
        "_part", (F.sum("_s").over(Window.orderBy("_part")) - F.col("_s")).alias("_offset")
    )
    within = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranked.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.sum(value).over(within))
        .drop("_part", "_pos", "_offset")
    )


def constant_batch(rn: Column, size: int) -> Column:
    """Batch number (from 0) for fixed-size batches over a 0-based position."""
    return F.floor(rn / F.lit(size)).cast("bigint")


def increasing_batch(rn: Column, step: int) -> Column:
    """Batch number (from 1) when batch k holds ``k * step`` rows (0-based position).

    Row r (1-based) is in batch k when step*k(k-1)/2 < r <= step*k(k+1)/2, i.e.
    k = ceil((sqrt(8 r / step + 1) - 1) / 2).
    """
    r = (rn + F.lit(1)).cast("double")
    return F.ceil((F.sqrt(F.lit(8.0) * r / F.lit(float(step)) + F.lit(1.0)) - F.lit(1.0)) / F.lit(2.0)).cast("bigint")


def assign_constant(df: DataFrame, order: list, size: int, name: str = "batch_no") -> DataFrame:
    return with_row_number(df, order).withColumn(name, constant_batch(F.col("rn"), size))


def assign_increasing(df: DataFrame, order: list, step: int, name: str = "batch_id") -> DataFrame:
    return with_row_number(df, order).withColumn(name, increasing_batch(F.col("rn"), step))


def random_batch_sizes(spark, n_batches: int, lo: int, hi: int, salt: str = "batch") -> DataFrame:
    """Batch table (batch_id from 1, size in [lo, hi]) from a hash of the batch number."""
    return spark.range(1, n_batches + 1).select(
        F.col("id").alias("batch_id"),
        (F.lit(lo) + md5_bucket(F.col("id"), hi - lo + 1, salt)).cast("int").alias("batch_size"),
    )


def assign_random(df: DataFrame, order: list, lo: int, hi: int, salt: str = "batch",
                  name: str = "batch_id") -> DataFrame:
    """Random-size micro-batches: sizes in [lo, hi] drawn per batch number.

    Every batch but the last is full; rows go to the batch whose [start, end)
    holds their position. The position-to-batch range join is an equi-join on
    ``position div lo`` (a batch spans at most ceil(hi/lo)+1 such buckets).
    """
    spark = df.sparkSession
    numbered = with_row_number(df, order)
    total = numbered.count()
    n_batches = max(1, -(-total // lo))
    sizes = random_batch_sizes(spark, n_batches, lo, hi, salt)
    bounds = with_running_sum(sizes, [F.col("batch_id")], "batch_size", "_end").select(
        "batch_id", "batch_size", (F.col("_end") - F.col("batch_size")).alias("_start"), "_end"
    ).filter(F.col("_start") < F.lit(total))
    spans = bounds.withColumn(
        "_bucket",
        F.explode(F.sequence(F.floor(F.col("_start") / lo), F.floor((F.col("_end") - 1) / lo))),
    )
    rows = numbered.withColumn("_bucket", F.floor(F.col("rn") / lo))
    joined = rows.join(spans, "_bucket").filter(
        (F.col("rn") >= F.col("_start")) & (F.col("rn") < F.col("_end"))
    )
    return joined.drop("_bucket", "_start", "_end", "batch_size").withColumnRenamed("batch_id", name)


def shuffle_positions(df: DataFrame, key: str, salt: str = "", name: str = "position") -> DataFrame:
    """Reproducible full shuffle: position in the order of md5(salt || key), then key."""
    return with_row_number(df, [md5_int(F.col(key), salt), F.col(key)], name=name)


def sample_with_replacement(df: DataFrame, order: list, draws: int | None = None,
                            salt: str = "draw") -> DataFrame:
    """``draws`` picks over all rows with replacement (default: as many as rows).

    Draw d takes row ``md5(salt || d) mod n`` (60 bits of it); the draw table is joined to the
    numbered rows on position (an equi-join; a row may be drawn many times).
    """
    spark = df.sparkSession
    numbered = with_row_number(df, order)
    n = numbered.count()
    k = n if draws is None else draws
    picks = spark.range(0, k).select(
        F.col("id").alias("draw"), (md5_long(F.col("id"), salt) % F.lit(max(n, 1))).alias("rn")
    )
    return picks.join(numbered, "rn").drop("rn")
