"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(app: str = "stayflow", cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench. On a cluster the session comes from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: the cluster's checkpoint folder.

    The setting is taken from the session. Only a local session without it gets a temporary folder, which
    is then written back to the session so that later calls agree.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_CONF} must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="stayflow-")
    spark.conf.set(CHECKPOINT_CONF, path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    import uuid

    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder once nothing reads it any more."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
