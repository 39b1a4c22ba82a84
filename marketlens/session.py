"""Session settings and the shared work folder.

The library never builds a session behind a caller's back; ``get_session`` is
for the command line, tests, the bench and scripts. ``work_dir`` names the shared folder that
file sinks and lineage cuts write to: the cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# What results depend on: the UTC wall clock of date_trunc and CSV timestamps.
RESULT_CONF = {"spark.sql.session.timeZone": "UTC"}

# Wished for, but never over a caller's own setting: split a skewed join
# partition even when the split costs one more exchange downstream (only
# happens when skew is detected).
DEFAULT_CONF = {"spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "marketlens", extra: dict | None = None) -> SparkSession:
    """A session. Master, partition count and memory are whatever ``spark-submit`` or the
    environment says, unless given here."""
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_report_conf(spark)
    return spark


def apply_report_conf(spark: SparkSession) -> None:
    """Set what results depend on, and the other settings only where the session has none."""
    for k, v in RESULT_CONF.items():
        spark.conf.set(k, v)
    for k, v in DEFAULT_CONF.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written tables: the session's checkpoint directory.

    Raises when the session names none: the library chooses no folder, as one on
    the driver's disk would be out of the executors' sight.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared work folder."""
    return f"{work_dir(spark)}/marketlens/{name}-{uuid.uuid4().hex[:12]}"


def cluster_conf(shuffle_bytes: int, target_partition_bytes: int = 256 << 20,
                 max_split_bytes: int = 512 << 20) -> dict[str, str]:
    """Settings for a cluster run sized from the largest expected shuffle.

    ``shuffle.partitions`` starts at ``shuffle_bytes / target_partition_bytes``
    (AQE coalesces downwards from there at run time), file splits are
    ``max_split_bytes``, and a join partition counts as skewed from five times
    the median and four advisory sizes on, when AQE splits it.
    """
    partitions = max(200, -(-shuffle_bytes // target_partition_bytes))
    return {
        **RESULT_CONF, **DEFAULT_CONF,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(max_split_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }
