"""Top-1 per group as an aggregate (partial + final), not a per-group sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_struct(order: list[str], payload: list[str], when: Column | None = None) -> Column:
    """Aggregate expression: the ``payload`` struct of the row largest by ``order``
    among rows where ``when`` holds (null if none). Several can share one pass."""
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                      *[F.col(c).alias(c) for c in payload])
    best = F.max(packed if when is None else F.when(when, packed))
    return F.when(best.isNotNull(), F.struct(*[best[c].alias(c) for c in payload]))


def latest_per_group(df: DataFrame, group: list[str], order: list[str],
                     payload: list[str]) -> DataFrame:
    """For each group keep the row that is largest by ``order`` (a total order).

    ``max(struct(order..., payload...))`` is combined map-side, so even a group
    holding a third of all rows is reduced in every task before the shuffle.
    """
    best = df.groupBy(*group).agg(latest_struct(order, payload).alias("_best"))
    return best.select(*group, *[F.col(f"_best.{c}").alias(c) for c in payload])
