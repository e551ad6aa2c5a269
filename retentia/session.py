"""Session helpers (local sessions for tests and the bench; clusters bring their own)."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench assume."""
    builder = SparkSession.builder
    log_dir = os.environ.get("RETENTIA_EVENT_LOG_DIR")  # stage / task times without the UI
    if log_dir:
        os.makedirs(log_dir, exist_ok=True)
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
    spark = (
        builder.master(f"local[{cores}]")
        .appName("retentia")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", os.environ.get("RETENTIA_SESSION_TZ", "UTC"))
        .config("spark.driver.memory", os.environ.get("RETENTIA_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``)."""
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder (``spark.checkpoint.dir``).

    Where none is set, a local session gets a temporary folder of its own; on a cluster that is an error, since a
    machine's own folder is not seen by the others.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            d = tempfile.mkdtemp(prefix="retentia-checkpoints-")
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int = 4,
                 target_partition_bytes: int = 256 * 1024 ** 2, aggregate_reduction: int = 8) -> dict[str, str]:
    """Settings for a cluster run, sized from the event log's size.

    * Scan splits: a few tasks per core, 128 MB to 1 GB each.
    * First shuffle: it carries the partially aggregated (user, week) rows, not
      the events, so it starts with about one partition per
      ``target_partition_bytes`` of *post-aggregation* data (input divided by
      ``aggregate_reduction``), at least 2x the cores and at most 100,000
      (map tasks x reduce partitions is the shuffle block count).  AQE then
      coalesces small partitions and splits skewed ones at run time.

    Pass the result to ``SparkSession.builder.config(map=...)``.
    """
    cores = executors * cores_per_executor
    split = min(1024 ** 3, max(128 * 1024 ** 2, input_bytes // max(1, 4 * cores)))
    shuffle_bytes = input_bytes // max(1, aggregate_reduction)
    initial = min(100_000, max(2 * cores, -(-shuffle_bytes // target_partition_bytes)))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(initial),
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 ** 2),
    }
