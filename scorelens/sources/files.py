"""File sources: nested / line JSON, CSV (text or typed), labelled text, path columns.

One ``spark.read`` over a directory or glob replaces per-file reads and unions;
columns that live in the path come from ``_metadata.file_path``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json_nested(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Whole-file JSON documents (object or array root) with an explicit schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_named_json_documents(spark: SparkSession, root: str, file_name: str, schema: StructType,
                              path_col: str = "path") -> DataFrame:
    """Every ``file_name`` under ``root`` (any depth) as whole-file JSON documents,
    with each row's file path. A recursive listing with a file-name filter, not
    a glob: folder names such as ``<model>:<env>`` are valid here, while a path
    glob rejects a ``:`` inside a path component."""
    return (spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
            .option("pathGlobFilter", file_name).json(root)
            .withColumn(path_col, F.col("_metadata.file_path")))


def read_json_lines(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """JSON lines; pass a schema in production (inference scans the data twice)."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path)


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header, every column as text (cast explicitly afterwards)."""
    return spark.read.option("header", True).csv(path)


def read_csv_typed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


CSV_TEXT_OPTIONS = {
    "header": "true", "multiLine": "true", "escape": '"', "quote": '"',
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def read_labelled_text(spark: SparkSession, path: str, content: str = "Content",
                       label: str = "Label") -> DataFrame:
    """Labelled text CSV (quoted, multi-line cells); labels that are not integers
    (a repeated header, junk, null) are dropped after ``try_cast``."""
    raw = spark.read.options(**CSV_TEXT_OPTIONS).schema(f"`{content}` STRING, `{label}` STRING").csv(path)
    return raw.select(F.col(content).alias("content"), F.col(label).try_cast("int").alias("label")).filter(
        F.col("label").isNotNull())


def with_path_column(df: DataFrame, name: str, pattern: str, group: int = 1) -> DataFrame:
    """Add a column parsed from each row's source file path."""
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, group))


def read_with_path_columns(spark: SparkSession, path: str, fmt: str, columns: dict[str, str],
                           schema: StructType | None = None, file_name: str | None = None) -> DataFrame:
    """Read every file under ``path`` (recursively) and parse ``columns`` from the path.

    ``columns`` maps a column name to a regex whose first group is the value;
    ``file_name`` (a glob on the file name only) skips other files in the tree,
    e.g. logs beside the data.
    """
    reader = spark.read.format(fmt).option("recursiveFileLookup", True)
    if file_name:
        reader = reader.option("pathGlobFilter", file_name)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    for name, pattern in columns.items():
        df = with_path_column(df, name, pattern)
    return df
