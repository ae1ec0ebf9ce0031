"""Session settings and lineage cutting.

The library never creates its own SparkSession in queries; callers pass one in.
``build_session`` is for tests, the bench and local runs.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

# Settings every session should carry. Broadcasts are decided on *measured*
# sizes only: the static threshold (which trusts file-size estimates) is off,
# and AQE turns a sort-merge join into a broadcast join when the finished
# shuffle stage of one side is below the adaptive threshold. Tables bounded by
# construction carry an explicit broadcast hint instead. AQE also coalesces
# small shuffle partitions and splits skewed join partitions.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
    # checkpoint files of DataFrames that are no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def scale_conf(input_bytes: int, partition_bytes: int = 256 << 20,
               min_partitions: int = 200, max_partitions: int | None = None) -> dict[str, str]:
    """Partition sizing for a cluster run over ``input_bytes`` of parquet.

    Scan splits and shuffle partitions both target ``partition_bytes`` so a
    task's data fits in executor memory with room to spill; AQE then merges
    small shuffle partitions and splits skewed ones. With ``max_partitions`` (the driver tracks
    a block per map and reduce task) shuffle partitions grow instead: at 100 TB 372,530 of
    256 MB, or 100,000 of 1 GB.
    """
    parts = max(min_partitions, -(-input_bytes // partition_bytes))
    parts = min(parts, max_partitions or parts)
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
    }


def apply_conf(spark: SparkSession, conf: dict[str, str]) -> None:
    for k, v in conf.items():
        spark.conf.set(k, v)


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "parkops") -> SparkSession:
    """A session with ``SESSION_CONF``. Submitted to a cluster (``spark.master`` is set), its
    master, memory and partitions are the submitter's; else it is local."""
    submitted = SparkConf().get("spark.master")
    b = SparkSession.builder.appName(app).config("spark.ui.showConsoleProgress", "false")
    if master or not submitted or submitted.startswith("local"):
        b = (b.master(master or f"local[{os.environ.get('BENCH_CPUS', '8')}]")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.driver.memory", "8g"))
    for k, v in SESSION_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if master or not submitted or submitted.startswith("local"):
        ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder named by the cluster, if any."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        spark.sparkContext.setCheckpointDir(conf)
        return spark.sparkContext.getCheckpointDir()
    return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the configured checkpoint folder; only a local session (tests) may do
    without and gets a fresh scratch folder. Never a machine-local folder on a
    cluster."""
    d = checkpoint_dir(spark)
    if d is None:
        if not spark.sparkContext.master.startswith("local") \
                or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parkops-ckpt-"))
        d = spark.sparkContext.getCheckpointDir()
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder (survives executor
    loss). Callers rely on both of two later reads seeing the same rows in the
    same partitions, so a cluster session without a folder is an error; a local
    one gets a scratch folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
