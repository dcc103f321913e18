"""Bootstrap bands of grouped means in one pass over the data.

Resampling n rows with replacement gives each row a count; over many rows these counts are independent Poisson(1)
draws, so every row can draw its own count for every replicate from a hash of its key, wherever it lies. A row
draws ``PER_BLOCK`` counts from one md5 (``BITS`` bits each); a group's replicates are sums of weights and of weighted values,
added up within each Arrow batch (its rows are never multiplied by their blocks) and by a final aggregate, ``PER_BLOCK`` replicates to a row.
Before that the rows are brought together by group, a group of more than ``SALT_ROWS`` rows in as many parts as it takes, so that
the batches' sums shrink the data whatever a group's size. The band is the percentile interval of the replicates' means.

A replicate that drew nothing from a small group has no mean and is left out of its percentiles.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from scorelens.operators.joins import checked_broadcast

PER_BLOCK, BITS = 8, 15  # 2 x 60 bits of an md5
SALT_ROWS = 20_000  # rows of a group that one task multiplies


def poisson_thresholds(bits: int = BITS) -> list[int]:
    """Draws u in [0, 2^bits) count how many thresholds are at most u: Poisson with mean 1."""
    out, mass, total, k = [], math.exp(-1), 0.0, 0
    while True:
        total += mass
        edge = round(total * (1 << bits))
        if edge >= 1 << bits or (out and edge == out[-1]):
            return out
        out.append(edge)
        k += 1
        mass /= k


def poisson_weight(draw: Column) -> Column:
    """The count that a draw stands for."""
    weight = F.lit(0.0)
    for t in poisson_thresholds():
        weight = weight + (draw >= t).cast("double")
    return weight


def block_weights(names: list[bytes], block: int) -> np.ndarray:
    """The counts that rows draw in a block, a row of PER_BLOCK each; ``names``: what a row's md5 is made of before the block's number."""
    number = str(block).encode()
    digests = b"".join([hashlib.md5(name + number, usedforsecurity=False).digest() for name in names])
    high, low = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2).T
    halves = (high >> np.uint64(4), (high & np.uint64(15)) << np.uint64(56) | low >> np.uint64(8))  # 15 hexadecimal digits each
    draws = np.stack([halves[k // 4] >> np.uint64(BITS * (k % 4)) & np.uint64((1 << BITS) - 1) for k in range(PER_BLOCK)], axis=1)
    return _counts()[draws.astype(np.int64)]


@lru_cache(maxsize=1)
def _counts() -> np.ndarray:
    """The count that each draw stands for."""
    return np.searchsorted(poisson_thresholds(), np.arange(1 << BITS), side="right").astype(float)


def _weighted_sums(rows: DataFrame, keys: list[str], values: list[str], blocks: int, salt: str) -> DataFrame:
    """(keys, _block, <value>_w<k>, <value>_s<k>): sums of weights and of weighted values, a row a group, block and Arrow batch.

    ``rows``: (keys, values double, _row string). A batch is grouped once and then weighted block by block.
    """
    names = [f"{v}_{kind}{k}" for v in values for k in range(PER_BLOCK) for kind in "ws"]
    schema = StructType([*(rows.schema[k] for k in keys), StructField("_block", IntegerType()), *(StructField(n, DoubleType()) for n in names)])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            number = np.zeros(batch.num_rows, np.int64)
            for key in keys:
                coded = batch.column(key).dictionary_encode()
                number = number * (len(coded.dictionary) + 1) + coded.indices.fill_null(-1).to_numpy(zero_copy_only=False) + 1
                number = np.unique(number, return_inverse=True)[1]
            order = np.argsort(number, kind="stable")
            starts = np.flatnonzero(np.diff(number[order], prepend=-1))
            groups = [batch.column(key).take(pa.array(order[starts])) for key in keys]
            own = [f"{salt}:" if row is None else f"{salt}:{row}:" for row in batch.column("_row").to_pylist()]
            own = [own[at].encode() for at in order.tolist()]
            columns = [batch.column(v).take(pa.array(order)) for v in values]
            there = [c.is_valid().to_numpy(zero_copy_only=False)[:, None].astype(float) for c in columns]
            known = [c.fill_null(0.0).to_numpy(zero_copy_only=False)[:, None] for c in columns]
            for block in range(blocks):
                weights = block_weights(own, block)
                sums = [[np.add.reduceat(weights * part[j], starts) for part in (there, known)] for j in range(len(values))]
                flat = [pa.array(part[:, k]) for both in sums for k in range(PER_BLOCK) for part in both]
                yield pa.RecordBatch.from_arrays([*groups, pa.array(np.full(len(starts), block, np.int32)), *flat], names=[*keys, "_block", *names])

    return rows.select(*keys, *values, "_row").mapInArrow(run, schema)


def draws_sql(digest: str) -> str:
    """A block's counts from its md5 as a list, in SQL for oracles."""
    halves = [f"CAST('0x' || substr({digest}, {at}, 15) AS BIGINT)" for at in (1, 16)]
    draws = ", ".join(f"({halves[k // 4]} >> {BITS * (k % 4)}) & {(1 << BITS) - 1}" for k in range(PER_BLOCK))
    return f"list_transform([{draws}], lambda u: len(list_filter({poisson_thresholds()}, lambda t: t <= u)))"


def replicate_means(df: DataFrame, keys: list[str], values: list[str], row_key: Column, replicates: int, salt: str = "") -> DataFrame:
    """(keys, <value>): per keys the sorted means of the replicates that drew any of the non-null values."""
    blocks = -(-replicates // PER_BLOCK)
    rows = df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values], row_key.cast("string").alias("_row"))
    sizes = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).alias("_parts"))
    rows = rows.join(checked_broadcast(sizes), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*[f"_{k}" for k in keys])
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_row"), "_parts")).repartition(*keys, "_part").drop("_part", "_parts")
    sums = [F.sum(f"{v}_{kind}{k}").alias(f"{v}_{kind}{k}") for v in values for k in range(PER_BLOCK) for kind in "ws"]
    summed = _weighted_sums(rows.sortWithinPartitions(*keys), keys, values, blocks, salt).groupBy(*keys, "_block").agg(*sums)
    mean = lambda v, k: F.when((F.col("_block") * PER_BLOCK + k < replicates) & (F.col(f"{v}_w{k}") > 0), F.col(f"{v}_s{k}") / F.col(f"{v}_w{k}"))
    each = summed.select(*keys, *[F.array(*[mean(v, k) for k in range(PER_BLOCK)]).alias(v) for v in values])
    return each.groupBy(*keys).agg(*[F.array_sort(F.array_compact(F.flatten(F.collect_list(v)))).alias(v) for v in values])  # ``replicates`` numbers a group


def percentile_of(ordered: Column, p: float) -> Column:
    """The linearly interpolated percentile of a sorted array."""
    at = (F.size(ordered) - 1) * F.lit(p)
    low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    return F.when(F.size(ordered) > 0, low + (high - low) * (at - F.floor(at)))


def bootstrap_band(df: DataFrame, keys: list[str], values: list[str], row_key: Column, replicates: int = 1000,
                   level: float = 0.95, salt: str = "", digits: dict[str, int] | int = 9) -> DataFrame:
    """Per keys and metric: count, mean, and the percentile band of the bootstrapped means.

    ``row_key`` names a row: equal keys draw equal counts, and results do not depend on how rows are partitioned.
    """
    ends = {"low": (1 - level) / 2, "high": (1 + level) / 2}
    round_to = digits if isinstance(digits, dict) else dict.fromkeys(values, digits)
    bands = replicate_means(df, keys, values, row_key, replicates, salt)
    bands = bands.select(*[F.col(k).alias(f"_{k}") for k in keys], *[percentile_of(F.col(v), p).alias(f"{v}_{end}") for v in values for end, p in ends.items()])
    plain = df.groupBy(*keys).agg(*[f for v in values for f in (F.count(v).alias(f"{v}_n"), F.avg(F.col(v).cast("double")).alias(f"{v}_mean"))])
    joined = plain.join(bands, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    metric = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(f"{v}_n").alias("n"), F.round(f"{v}_mean", round_to[v]).alias("mean"),
                                F.round(f"{v}_low", round_to[v]).alias("ci_low"), F.round(f"{v}_high", round_to[v]).alias("ci_high")) for v in values])
    return joined.select(*keys, F.inline(metric)).where(F.col("n") > 0)
