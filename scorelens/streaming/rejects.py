"""Records of micro-batch files, parsed one by one: what can be scored, and a dead-letter table of what cannot.

A line is a JSON array of records or one record. An array that is broken anywhere cannot be cut into records and is rejected as a whole
line; everything else is judged record by record. Nothing is dropped: accepted and rejected records add up to what the files hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelens.streaming.microbatch import IMAGE_SCHEMA
from scorelens.streaming.tracker import read_log

REJECTS = "file string, reason string, raw string"
_PARSED = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in IMAGE_SCHEMA) + ", _corrupt_record string"


def parse_records(lines: DataFrame) -> DataFrame:
    """(file, raw, reason, id, idx, data, label) for each record of (value, file) lines; ``reason`` is null for a record that can be scored.

    Reasons: ``broken array``, ``malformed`` (no JSON object, or a field of another type), ``no data``, ``bad data`` (a null among the
    values), ``no label``; the first that holds. Blank lines are no records.
    """
    text = F.trim("value")
    array = F.from_json(text, "array<string>")  # each element's own text
    listed = text.startswith("[")
    broken = listed & array.isNull()
    raws = F.when(listed & ~broken, F.transform(array, lambda x: F.coalesce(x, F.lit("null")))).otherwise(F.array("value"))
    split = lines.where(text != "").select("file", broken.alias("broken"), F.explode(raws).alias("raw"))
    read = split.withColumn("r", F.from_json("raw", _PARSED, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    whole = F.trim("raw").startswith("{") & F.trim("raw").endswith("}")
    reason = (F.when(F.col("broken"), "broken array").when(~whole | F.col("r").isNull() | F.col("r._corrupt_record").isNotNull(), "malformed")
              .when(F.col("r.data").isNull(), "no data").when(F.exists("r.data", lambda x: x.isNull()), "bad data").when(F.col("r.label").isNull(), "no label"))
    return read.select("file", "raw", reason.alias("reason"), *[F.col(f"r.{f.name}").alias(f.name) for f in IMAGE_SCHEMA])


def write_rejects(parsed: DataFrame, tracker_dir: str, consumer: str, epoch: int) -> None:
    """The epoch's dead letters; a replayed epoch replaces its own."""
    (parsed.where(F.col("reason").isNotNull()).select("file", "reason", "raw").write.mode("overwrite")
     .parquet(f"{tracker_dir}/rejects/consumer=c_{consumer}/epoch={epoch}"))


def rejects(spark: SparkSession, tracker_dir: str) -> DataFrame:
    """All dead letters: (file, reason, raw, consumer, epoch)."""
    return read_log(spark, f"{tracker_dir}/rejects", REJECTS)
