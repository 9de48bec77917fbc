"""Session set-up. Nothing here is machine specific: a cluster's own settings win."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Maps built from two sources keep the newer entry.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on (idempotent)."""
    for key, value in _DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def build_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "tidelens", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", conf.pop("driver_memory", "12g")))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder for files of one job, below the folder that checkpoints use."""
    if spark.sparkContext.getCheckpointDir() is None:
        durable_checkpoint(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def list_paths(spark: SparkSession, pattern: str) -> list:
    """Paths that match a pattern in whatever file system it names."""
    root = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return [s.getPath() for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root) or []]


def durable_checkpoint(df, eager: bool = True):
    """Cut the lineage of an iterative job with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. A local session, which has
    no other machines, may go without and then gets a scratch folder; a cluster may not.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidelens-ckpt-"))
    return df.checkpoint(eager=eager)
