"""Times are epoch seconds as double; timestamps are only for display.

Table times load as TIMESTAMP_NTZ, so the conversions below are independent of
the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_seconds(ts) -> Column:
    """TIMESTAMP_NTZ -> double seconds since the epoch."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), _c(ts)) / F.lit(1e6)


def epoch_to_timestamp(seconds) -> Column:
    """Double epoch seconds -> TIMESTAMP_NTZ (microsecond precision)."""
    micros = F.round(_c(seconds) * F.lit(1e6)).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, F.expr(_EPOCH))


def placeholder_zero(value, placeholder: str = "-") -> Column:
    """``'-'`` where a time (or span) is zero, else the value as text.

    The value is cast to string explicitly: a CASE mixing '-' with a timestamp
    would resolve to timestamp and fail under ANSI mode.
    """
    v = _c(value)
    return F.when(v.cast("bigint") == 0, F.lit(placeholder)).otherwise(v.cast("string"))
