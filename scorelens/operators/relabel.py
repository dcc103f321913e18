"""Relabelling, unpivoting and normalising for chart-ready frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def relabel(col, mapping: dict, otherwise=None) -> Column:
    """CASE chain: mapped value where the column equals a key, else unchanged."""
    c = _c(col)
    out = None
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)) if out is None else out.when(c == F.lit(k), F.lit(v))
    fallback = c if otherwise is None else _c(otherwise)
    return fallback if out is None else out.otherwise(fallback)


def unpivot(df: DataFrame, by: list[str], var_name: str = "category",
            value_name: str = "normalized_value") -> DataFrame:
    """All columns but ``by`` become (category, value) rows; values cast to double."""
    cols = [c for c in df.columns if c not in by]
    typed = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    return typed.unpivot(by, cols, var_name, value_name)


def normalise_by_max(df: DataFrame, cols: list[str], digits: int | None = None) -> DataFrame:
    """Divide each column by its global maximum.

    The maxima come from one aggregate used as scalar subqueries: one extra job
    over the data (partial aggregation), no single-task window and no driver loop.
    """
    maxima = df.select(*[F.max(F.col(c).cast("double")).alias(c) for c in cols])
    out = df
    for c in cols:
        value = F.try_divide(F.col(c).cast("double"), maxima.select(c).scalar())
        out = out.withColumn(c, F.round(value, digits) if digits is not None else value)
    return out
