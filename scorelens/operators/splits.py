"""Reproducible splitting and sampling by md5 bucket of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelens.functions.hashing import md5_bucket


def hash_split(df: DataFrame, key: str, train_pct: int = 98, salt: str = "",
               name: str = "split") -> DataFrame:
    """Label each row ``train`` (bucket < train_pct) or ``test``; a disjoint cover."""
    return df.withColumn(
        name, F.when(md5_bucket(F.col(key), 100, salt) < train_pct, F.lit("train")).otherwise(F.lit("test"))
    )


def train_part(df: DataFrame, key: str, train_pct: int = 98, salt: str = "") -> DataFrame:
    return df.filter(md5_bucket(F.col(key), 100, salt) < train_pct)


def rest_after(all_rows: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """All rows minus the taken ones, by key (anti-join)."""
    return all_rows.join(taken.select(key), key, "left_anti")


def bernoulli_sample(df: DataFrame, key: str, pct: int = 5, salt: str = "",
                     native_seed: int | None = None) -> DataFrame:
    """Keep about ``pct`` percent of rows, the same rows on every run.

    With ``native_seed`` Spark's own ``sample`` is used instead: cheaper (no
    hash), but its draw depends on the partitioning, so it is reproducible only
    for the same input layout.
    """
    if native_seed is not None:
        return df.sample(withReplacement=False, fraction=pct / 100.0, seed=native_seed)
    return df.filter(md5_bucket(F.col(key), 100, salt) < pct)


def native_split(df: DataFrame, train_pct: int, seed: int, name: str = "split") -> DataFrame:
    """``randomSplit`` labelled train/test (partition-dependent; see ``hash_split``)."""
    train, test = df.randomSplit([train_pct / 100.0, 1 - train_pct / 100.0], seed=seed)
    return train.withColumn(name, F.lit("train")).unionByName(test.withColumn(name, F.lit("test")))
