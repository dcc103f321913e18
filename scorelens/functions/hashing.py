"""Reproducible pseudo-randomness from md5 of a key (independent of partitioning)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def md5_int(key, salt: str = "") -> Column:
    """First 32 bits of md5(salt || key) as a non-negative bigint."""
    text = _c(key).cast("string")
    if salt:
        text = F.concat(F.lit(salt), text)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def md5_bucket(key, buckets: int = 100, salt: str = "") -> Column:
    """Bucket in [0, buckets) of md5(salt || key)."""
    return md5_int(key, salt) % F.lit(buckets)


def md5_long(key, salt: str = "") -> Column:
    """First 60 bits of md5(salt || key) as a non-negative bigint."""
    text = _c(key).cast("string")
    if salt:
        text = F.concat(F.lit(salt), text)
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
