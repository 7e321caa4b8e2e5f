"""Session construction and shared storage locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every fundflow session wants. AQE re-plans joins from runtime sizes
# (it only broadcasts a side whose *measured* size is under the threshold), merges
# small shuffle partitions and splits skewed join partitions.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def cluster_conf(input_bytes: int, target_partition_bytes: int = 256 * 1024 ** 2) -> dict:
    """Settings for a large cluster, sized from the bytes a job reads.

    Shuffle partitions start at input / 256 MB (AQE merges small partitions toward the
    advisory size and splits skewed join partitions), scans cut files into 256 MB
    splits, and broadcast joins keep the measured-size threshold.
    """
    shuffle = max(200, int(input_bytes // target_partition_bytes))
    size = str(target_partition_bytes)
    return {
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
    }


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "fundflow", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the fundflow defaults.

    ``master`` is only applied when given: on a cluster the launcher decides it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_FALLBACK_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for staged tables and checkpoints.

    Read from ``spark.checkpoint.dir`` as the session names it (a static setting:
    it can only come from the launcher / spark-defaults). Only when a local master
    leaves it unset (tests) is a private scratch folder created once per application
    and registered with ``SparkContext.setCheckpointDir``, so lineage cuts still have
    somewhere to go; on a cluster an unset folder is an error, since the driver's
    disk is not the executors'.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _FALLBACK_DIRS.get(sc.applicationId)
        if path is None:
            path = tempfile.mkdtemp(prefix="fundflow-")
            _FALLBACK_DIRS[sc.applicationId] = path
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def new_location(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused location under the shared folder."""
    return f"{shared_dir(spark)}/{name}/{uuid.uuid4().hex}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme so local-only helpers (tests) can list files."""
    return path[5:] if path.startswith("file:") else path


def env_int(name: str, default: int) -> int:
    try:
        return int(os.environ.get(name, default))
    except ValueError:
        return default


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder this library staged, once nothing reads it any more.

    Uses the Hadoop file system of the path (same as Spark's own writers), so it
    works for the cluster's shared storage as well as local folders.
    """
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)
