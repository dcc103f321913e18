"""Session construction and shared scratch space.

Scratch data (round trips, checkpoints, stream state) always lives under the
cluster's ``spark.checkpoint.dir``; a local temporary folder is used only when
the session has none configured (unit tests, local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "scorelens", master: str | None = None,
                shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TARGET_PARTITION_BYTES))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Checkpointed frames (global numbering) are removed once unreferenced.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Arrow batches of 3,072-value arrays or 30k-char texts: keep them small.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


# Bytes per task: scan splits and post-shuffle partitions are sized to this.
TARGET_PARTITION_BYTES = 128 * 1024 * 1024


def tune_for_input(spark: SparkSession, input_bytes: int, cores: int) -> dict[str, str]:
    """Size scans and shuffles for an input of ``input_bytes`` on ``cores`` task slots.

    Scan splits of 128 MB; an initial shuffle partition count of input / 128 MB
    (at least 2 waves of tasks), which AQE then coalesces to the advisory size;
    skewed partitions are split by AQE. For 100 TB that is about 800k initial
    shuffle partitions, coalesced at runtime, so no task holds more than a few
    hundred MB before spilling.
    """
    partitions = max(2 * cores, -(-input_bytes // TARGET_PARTITION_BYTES))
    settings = {
        "spark.sql.files.maxPartitionBytes": str(TARGET_PARTITION_BYTES),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TARGET_PARTITION_BYTES),
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    return settings


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; set only when unset."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a driver-side context
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if sc is None or not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="scorelens-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", configured)
        except Exception:  # noqa: BLE001 - core configs may be fixed at runtime
            pass
    if sc is not None:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused folder under the checkpoint root."""
    return os.path.join(checkpoint_root(spark), "scorelens", f"{name}-{uuid.uuid4().hex[:12]}")
