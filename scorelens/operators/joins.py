"""Joins: dimension lookups behind a size check, keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest dimension broadcast without a shuffle; above it the planner decides.
DEFAULT_BROADCAST_ROWS = 100_000


def checked_broadcast(dim: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast-hint ``dim`` only after checking its row count is within bound."""
    n = dim.limit(max_rows + 1).count()
    return F.broadcast(dim) if n <= max_rows else dim


def lookup(facts: DataFrame, dim: DataFrame, key: str | list[str], flag: str | None = "missing",
           max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Left join to a dimension; ``flag`` marks facts whose key has no dimension row."""
    keys = [key] if isinstance(key, str) else list(key)
    marker = "_dim_hit"
    d = dim.withColumn(marker, F.lit(True))
    out = facts.join(checked_broadcast(d, max_rows), keys, "left")
    if flag:
        out = out.withColumn(flag, F.col(marker).isNull())
    return out.drop(marker)


def upsert_by_key(base: DataFrame, updates: DataFrame, key: str | list[str],
                  cols: list[str]) -> DataFrame:
    """Overwrite ``cols`` of ``base`` where ``updates`` has the key; keep others.

    One left join plus coalesce replaces N conditional rewrites of a table; the
    update frame holds at most one row per key (dedupe it before calling).
    """
    keys = [key] if isinstance(key, str) else list(key)
    u = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols])
    out = base.join(u, keys, "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.col(c))).drop(f"_new_{c}")
    return out
