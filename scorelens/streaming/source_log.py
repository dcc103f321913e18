"""What a file stream has consumed: its source log, the identity it gives to files, and the archive they move to."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelens.streaming.tracker import read_log

IDENTITY = "file string, place long, first_epoch long"


def consumed_files(spark: SparkSession, checkpoint_dir: str) -> DataFrame:
    """(file, epoch, modified) of every file that the stream has taken, from the log in its checkpoint.

    The log has an entry for each file in the file of its epoch, and again in compacted ones.
    """
    lines = spark.read.text(f"{checkpoint_dir}/sources/0").where(F.col("value").startswith("{"))
    entry = F.from_json("value", "path string, timestamp long, batchId long")
    return lines.select(entry.alias("e")).select(_plain(F.col("e.path")).alias("file"), F.col("e.batchId").alias("epoch"), F.col("e.timestamp").alias("modified")).distinct()


def register_files(spark: SparkSession, tracker_dir: str, name: str, checkpoint_dir: str, epoch: int) -> DataFrame:
    """The durable map from file to identity, after adding the files that ``epoch`` is the first to see.

    A file's ``place`` is its number in the order in which files were first seen (by epoch, then by modification time and path). With one file a
    trigger that is the epoch that first saw it; with several a trigger each file still has a place of its own. Rows are only ever added, a
    folder an epoch, so a replay of the epoch, a restart or a new checkpoint over the same files finds the places they had.
    """
    path = f"{tracker_dir}/files/name=n_{name}"
    known = read_log(spark, path, IDENTITY)
    seen = known.select("file", "place", "first_epoch")
    new = consumed_files(spark, checkpoint_dir).where(F.col("epoch") == epoch).join(seen, "file", "left_anti")
    arrived = new.agg(F.count(F.lit(1))).first()[0]
    if arrived:
        count = seen.agg(F.count(F.lit(1))).first()[0]
        order = Window.orderBy("modified", "file")  # the files of one trigger
        places = new.select("file", (F.row_number().over(order) - 1 + F.lit(count)).cast("long").alias("place"), F.lit(epoch).cast("long").alias("first_epoch"))
        places.coalesce(1).write.mode("append").parquet(f"{path}/epoch={epoch}")
        known = read_log(spark, path, IDENTITY)
    return known.select("file", "place", "first_epoch")


def identified(batch: DataFrame, places: DataFrame) -> DataFrame:
    """Add ``batch_id``: a row's own ``idx``, or its file's place where idx is null or 0; ``file`` names the row's file."""
    placed = batch.withColumn("file", _plain(F.col("file"))).join(F.broadcast(places.select("file", "place")), "file", "left")  # the files of a run, a number each
    return placed.withColumn("batch_id", F.coalesce(F.nullif(F.col("idx"), F.lit(0)), "place")).drop("place")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of all files below a folder, without reading any; no rows if there is no such folder."""
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(_plain(F.col("path")).alias("path"))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string")


def reconcile(spark: SparkSession, checkpoint_dir: str, input_dir: str, archive_dir: str) -> DataFrame:
    """(file, epoch, state) of every file that the source log, the input or the archive knows.

    ``state``: ``input`` or ``archive`` for a consumed file that lies in exactly one of them, ``both`` or ``lost`` for one that does not, ``waiting`` for an
    input file not taken yet, ``unlogged`` for an archived file that the log does not know.
    """
    log = consumed_files(spark, checkpoint_dir).groupBy("file").agg(F.min("epoch").alias("epoch"))
    waiting = listing(spark, input_dir).select(F.col("path").alias("file"), F.lit(True).alias("in_input"))
    prefix = F.lit(_plain_text(archive_dir))
    stored = listing(spark, archive_dir).select(F.substring(F.col("path"), F.length(prefix) + 1, F.length("path")).alias("file"), F.lit(True).alias("in_archive"))
    every = log.withColumn("logged", F.lit(True)).join(waiting, "file", "full").join(stored, "file", "full")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    state = (F.when(~yes("logged"), F.when(yes("in_archive"), "unlogged").otherwise("waiting"))
             .when(yes("in_input") & yes("in_archive"), "both").when(yes("in_input"), "input").when(yes("in_archive"), "archive").otherwise("lost"))
    return every.select("file", "epoch", state.alias("state"))


def _plain(path: Column) -> Column:
    """A path without scheme and escapes."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(path, "^[A-Za-z0-9+.-]+:/+", "/"), "[+]", "%2B"))


def _plain_text(path: str) -> str:
    head, colon, rest = path.partition(":/")
    return ("/" + rest.lstrip("/") if colon and "/" not in head else path).rstrip("/")
