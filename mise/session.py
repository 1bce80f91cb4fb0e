"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Bytes of wide rows that a task and its Python worker hold at a time; both hold them several times.
BATCH_BYTES_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
# Session key holding the fallback folder when the cluster names none.
LOCAL_DIR_KEY = "mise.fallback.checkpoint.dir"


def build_session(master: str | None = None, app: str = "mise",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A session tuned for wide page rows and skewed keys."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        # Only takes effect when this call launches the JVM (local runs, tests).
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # No broadcast chosen from plan-time estimates; AQE may still broadcast
        # a join side once its shuffle output has been measured.  Explicit hints
        # (a fixed dimension) still apply.
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Pages are wide rows (the html column); keep Arrow batches modest.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        # Small files of wide rows: split by bytes so tasks stay balanced.
        "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting wins, then a folder already set on the context; a local
    folder is chosen only on a local master that has neither (tests, a laptop).
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or spark.conf.get(LOCAL_DIR_KEY, None)
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # spark.checkpoint.dir is a core setting and cannot be changed at
        # runtime; the fallback is kept under this package's own key.
        path = os.path.join("/tmp", "mise-checkpoints")
        spark.conf.set(LOCAL_DIR_KEY, path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` from now on, for plans that run after their builder has
    returned: batches of Spark's 64 MB take an executor of 3 GB beyond its memory."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(BATCH_BYTES_KEY, str(BATCH_BYTES))
