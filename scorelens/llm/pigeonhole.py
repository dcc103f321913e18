"""Pigeonhole buckets over 64-bit fingerprints.

Cut a fingerprint into ``blocks`` parts: two fingerprints that differ in at most
``distance`` bits agree in at least ``blocks - distance`` of them, so they share one of the
C(blocks, blocks - distance) keys made of that many parts. With 6 parts and 3 bits a key
fixes about 32 bits, so chance meetings stay rare for billions of fingerprints.
A bucket of more than ``limit`` members (a large family of near copies) is cut again by
16 parts: a key then fixes 52 bits. What is still larger is dealt out in pairs of chunks.
Every pair within ``distance`` meets in some bucket, and no bucket has more than about
2 * ``limit`` members.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelens.llm.common import stored

BITS, COARSE, FINE = 64, 6, 16
CHOICE = 0x1E3779B97F4A7C15 >> 12  # spreads the numbers of the choices


def masks(blocks: int, distance: int) -> list[int]:
    """Signed 64-bit masks of all choices of ``blocks - distance`` parts."""
    ends = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(ends, ends[1:])]
    keys = [sum(choice) for choice in combinations(parts, blocks - distance)]
    return [k - (1 << BITS) if k >> (BITS - 1) else k for k in keys]


def _shared(nodes: DataFrame, blocks: int, distance: int) -> DataFrame:
    """(key, node, n): members of the keys that at least two nodes share, and how many do.

    A key is the chosen bits plus a number for the choice; should two choices meet in one key, that only adds
    candidates. One shuffle of 16 bytes a key; a large bucket is counted in a window that spills.
    """
    keys = F.array(*[(F.col("fp").bitwiseAND(F.lit(m).cast("long"))).bitwiseXOR(F.lit(k * CHOICE).cast("long"))
                     for k, m in enumerate(masks(blocks, distance))])
    keyed = nodes.select("node", F.explode(keys).alias("key"))
    return stored(keyed.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1"), "buckets", release=True)


def buckets(nodes: DataFrame, distance: int = 3, limit: int = 2048) -> DataFrame:
    """``nodes`` array<long> of each bucket; equal buckets under several keys come once.

    ``nodes``: (node long, fp long), one row a node. Nodes may share a fingerprint.
    """
    gather = F.array_sort(F.collect_list("node")).alias("nodes")
    coarse = _shared(nodes, COARSE, distance)
    out = coarse.where(F.col("n") <= limit).groupBy("key").agg(gather).select("nodes")
    large = coarse.where(F.col("n") > limit).select("node").distinct()
    if not large.isEmpty():
        fine = _shared(stored(nodes.join(large, "node", "left_semi"), "large"), FINE, distance)
        out = out.unionByName(fine.where(F.col("n") <= limit).groupBy("key").agg(gather).select("nodes"))
        chunks = F.ceil(F.col("n") / limit).cast("int")
        dealt = (fine.where(F.col("n") > limit)
                 .withColumn("own", F.pmod(F.xxhash64("node"), chunks).cast("int"))
                 .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1))))
        pairs = dealt.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        out = out.unionByName(pairs.agg(gather).select("nodes"))
    return out.where(F.size("nodes") > 1).distinct()
