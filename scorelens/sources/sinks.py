"""Sinks: CSV and JSON-lines tables, and JSON-array files (one array per file).

Every writer is a distributed DataFrame write (no pandas on the driver).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelens.sources.files import CSV_TEXT_OPTIONS


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", text_safe: bool = False) -> None:
    w = df.write.mode(mode)
    w = w.options(**CSV_TEXT_OPTIONS) if text_safe else w.option("header", True)
    w.csv(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_json_array_files(df: DataFrame, path: str, file_col: str, order: list[str], hidden: list[str] | None = None,
                           mode: str = "errorifexists", compression: str | None = None) -> None:
    """Write the rows of each value of ``file_col`` as one JSON array in one file under ``file_col=<v>/``.

    The array is streamed out record by record in the order of ``order``: its first record brings the opening bracket, its last the
    closing one, and the writer separates records by a blank, so a file of any size is one line and no task holds more than a
    record. The default mode refuses to overwrite, like an exclusive file create. ``hidden`` columns are not written.
    ``compression``: a codec of the text writer, or None.
    """
    payload = [c for c in df.columns if c not in (file_col, *(hidden or []))]
    in_file = Window.partitionBy(file_col).orderBy(*order)
    text = F.to_json(F.struct(*[F.col(c) for c in payload]))
    # All records of a file go to one task, in order, by one shuffle: one file per value at any size.
    ends = df.repartition(file_col).select(file_col, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], text.alias("_t"),
                     F.lag(F.lit(1)).over(in_file).isNull().alias("_first"), F.lead(F.lit(1)).over(in_file).isNull().alias("_last"))
    part = F.concat(F.when(F.col("_first"), "[").otherwise(","), "_t", F.when(F.col("_last"), "]").otherwise(""))
    lines = ends.sortWithinPartitions(file_col, *[f"_o{i}" for i in range(len(order))])
    lines.select(file_col, part.alias("value")).write.mode(mode).options(lineSep=" ", compression=compression or "none").partitionBy(file_col).text(path)
