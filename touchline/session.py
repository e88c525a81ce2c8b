"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job wants: AQE re-plans joins (small sides become broadcast
# joins from *runtime* sizes, skewed shuffle partitions are split) and the
# session time zone is pinned so timestamps compare equal across engines.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str = "local[*]",
    shuffle_partitions: int = 8,
    app_name: str = "touchline",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Local/test session. On a cluster the submitter's session is used as is."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("TOUCHLINE_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a session whose
    executors are threads of this machine (``local[...]``) may go without: it
    gets a fresh local folder. Elsewhere a machine-local folder would lose data,
    so the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="touchline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again: cuts the lineage
    with files that every executor can read."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/touchline-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Reducers of one shuffle at most: beyond it, map tasks times reducers are too many blocks to
#: fetch, and AQE splits what is large instead.
MAX_SHUFFLE_PARTITIONS = 20_000


def scale_conf(input_bytes: int, executor_cores_total: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings a cluster job sets from its input size: shuffle partitions of about
    ``target_partition_bytes``, two waves of tasks at least and
    ``MAX_SHUFFLE_PARTITIONS`` at most (AQE coalesces smaller ones and splits
    skewed ones), and input splits of the same size.

    >>> scale_conf(100 * 2**40, 8000)["spark.sql.shuffle.partitions"]
    '20000'
    """
    parts = min(MAX_SHUFFLE_PARTITIONS, max(2 * executor_cores_total, -(-input_bytes // target_partition_bytes)))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
