"""Small dimensions: label names and the model catalog.

Both are tiny literal tables (bounded size), so they are joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

# Class names of the ten-class image set, in label order 0..9.
LABEL_NAMES = ["airplane", "automobile", "bird", "cat", "deer", "dog", "frog", "horse", "ship", "truck"]

# Model catalog, name -> parameters (millions) and size (MB), in catalog order.
CATALOG = [
    ("facebook/convnext-tiny-224", 28.589, 109.059),
    ("facebook/convnext-small-224", 50.224, 191.588),
    ("facebook/convnext-base-224", 88.591, 337.950),
    ("facebook/convnext-large-224", 197.767, 754.423),
    ("facebook/convnextv2-nano-22k-224", 15.624, 59.600),
    ("facebook/convnextv2-tiny-22k-224", 28.635, 109.236),
    ("facebook/convnextv2-base-22k-224", 88.718, 338.432),
    ("facebook/convnextv2-large-22k-224", 197.957, 755.145),
    ("facebook/convnextv2-huge-1k-224", 660.290, 2518.805),
    ("google/vit-base-patch16-224", 86.568, 330.229),
    ("google/vit-large-patch16-224", 304.327, 1160.914),
    ("facebook/deit-tiny-patch16-224", 5.717, 21.810),
    ("facebook/deit-small-patch16-224", 22.051, 84.117),
    ("facebook/deit-base-patch16-224", 86.568, 330.229),
    ("facebook/deit-tiny-distilled-patch16-224", 5.911, 22.548),
    ("facebook/deit-base-distilled-patch16-224", 87.338, 333.169),
]

CATALOG_SCHEMA = StructType([
    StructField("position", IntegerType(), False),
    StructField("model", StringType(), False),
    StructField("params", DoubleType(), False),
    StructField("size", DoubleType(), False),
])


def label_names(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """(label, name) from an ordered name list: ``posexplode`` of one literal array."""
    arr = F.array(*[F.lit(n) for n in (names or LABEL_NAMES)])
    return spark.range(1).select(F.posexplode(arr).alias("label", "name")).select(
        F.col("label").cast("int"), "name")


def catalog(spark: SparkSession) -> DataFrame:
    """The model catalog as a 16-row DataFrame (position, model, params, size)."""
    rows = [(i, m, p, s) for i, (m, p, s) in enumerate(CATALOG)]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def catalog_sql(alias: str = "c") -> str:
    """The same catalog as a SQL VALUES list (for oracles)."""
    vals = ", ".join(f"({i}, '{m}', {p!r}::DOUBLE, {s!r}::DOUBLE)" for i, (m, p, s) in enumerate(CATALOG))
    return f"(VALUES {vals}) AS {alias}(position, model, params, size)"


def label_names_sql(names: list[str] | None = None, alias: str = "n") -> str:
    vals = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names or LABEL_NAMES))
    return f"(VALUES {vals}) AS {alias}(label, name)"
