"""Small helpers shared by the operators: table reads, stored intermediates, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scorelens.session import scratch_path

#: The six ASCII white-space characters of the contracts, `[\x20\x09-\x0D]`.
SPACES = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back.

    Cuts the lineage, so a lost executor never repeats what lies before, and a
    table that is used several times is computed once. ``release``: the write's shuffle files
    go when it ends, not when the driver's collector gets to them.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, str(release or before == "true").lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


#: Spark removes a query's shuffle files as soon as it has ended.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it while a column is called so (in either case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator works on, under fixed names, whatever else the table holds."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


#: What a Python worker keeps from task to task: {(operator, what it was made from): it}.
_KEPT: dict[tuple, Any] = {}


def kept(operator: str, source: Any, make: Callable[[Any], Any]) -> Any:
    """``make(source)``, once a Python worker and as long as it works for ``operator``."""
    if (operator, source) not in _KEPT:
        _KEPT.clear()
        _KEPT[operator, source] = make(source)
    return _KEPT[operator, source]


def forget_others(operator: str) -> None:
    """Drops what this Python worker has ``kept`` for operators other than this."""
    if any(name != operator for name, _ in _KEPT):
        _KEPT.clear()


def give_back() -> None:
    """Freed memory goes back to the system: a worker outlives its tasks, and others need what one of them took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, Any]]], schema: str, operator: str = "",
                slice_bytes: int | None = None) -> DataFrame:
    """``mapInArrow`` with Python lists: ``make()`` runs once a task and returns the function for each batch.

    Rows are handed on in slices of a bounded size (``slice_bytes``, else SLICE_BYTES), so a batch with very long texts never
    has all its Python strings alive at once. What the worker has ``kept`` for another operator goes first: workers outlive the stages of a pipeline.
    """
    out, most = StructType.fromDDL(schema), slice_bytes or SLICE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(operator)
        apply, arrow = make(), to_arrow_schema(out)
        try:
            for batch in batches:
                step = max(1, int(batch.num_rows * most / max(batch.nbytes, most)))
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    columns = apply({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type, from_pandas=False) for f in arrow], schema=arrow)
        finally:
            apply = batch = part = columns = None
            give_back()

    return df.mapInArrow(run, schema)


SLICE_BYTES = 4_000_000


def sliced(texts: pa.Array) -> Iterator[list]:
    """A column's values as Python lists, a bounded number of bytes at a time."""
    step = max(1, int(len(texts) * SLICE_BYTES / max(texts.nbytes, SLICE_BYTES)))
    for start in range(0, len(texts), step):
        yield texts.slice(start, step).to_pylist()


def crc32_mod(id_col: Column, n: int) -> Column:
    """crc32 of an id written as text, modulo ``n``; null ids give null."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(n)
