"""Session construction and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job wants regardless of cluster size. Shuffle width is left to
# AQE (coalescing + skew splitting); the static value is only a ceiling.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(
    master: str | None = None,
    app_name: str = "navframe",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or fetch) a session with the engine defaults applied.

    ``master`` and ``shuffle_partitions`` are only meant for local runs and
    tests; on a cluster the submitter provides them.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def _checkpoint_dir(spark: SparkSession) -> str | None:
    try:
        d = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # pragma: no cover - conf lookup on exotic sessions
        d = None
    if d:
        return d
    try:
        return spark.sparkContext.getCheckpointDir()
    except Exception:  # pragma: no cover - Spark Connect has no SparkContext
        return None


def shared_dir(spark: SparkSession, *parts: str, unique: bool = False) -> str:
    """A folder every executor can see: the cluster's ``spark.checkpoint.dir``.

    The setting is read from the session. Only when it is unset on a local
    master (local runs and tests) is a folder created and registered as the
    checkpoint dir, so that ``DataFrame.checkpoint()`` and written intermediate
    tables share it. Elsewhere a missing setting is an error: executors don't
    see the driver's temporary folders.
    """
    base = _checkpoint_dir(spark)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="navframe-shared-")
        try:
            spark.sparkContext.setCheckpointDir(base)
        except Exception:  # pragma: no cover
            pass
    path = os.path.join(base, *parts) if parts else base
    if unique:
        path = os.path.join(path, uuid.uuid4().hex)
    return path


def local_settings(cores: int) -> dict[str, str]:
    """Single-machine sizing (tests, bench): enough small partitions to keep
    every core busy on small inputs. AQE's default 1 MB floor for coalesced
    partitions and the 4 MB file open cost would otherwise leave a few-MB
    stage on 3-4 tasks."""
    return {
        "spark.sql.shuffle.partitions": str(2 * cores),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(256 * 1024),
        "spark.sql.files.openCostInBytes": str(1024 * 1024),
    }


def cluster_settings(
    shuffle_bytes: int,
    total_cores: int,
    target_partition_bytes: int = 256 * 1024 * 1024,
) -> dict[str, str]:
    """Cluster sizing from the expected bytes of the largest shuffle.

    The static shuffle width is a ceiling, sized so a partition is about
    ``target_partition_bytes`` (and at least three waves of tasks), so a task's
    sort and window buffers fit executor memory. AQE then coalesces by bytes,
    not for parallelism, and splits skewed join partitions above twice the
    target. Scan splits are half the target, and broadcasts are capped at 64 MB.
    """
    import math

    parts = max(3 * total_cores, math.ceil(shuffle_bytes / target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    }


#: a shuffle of NAV rows against the Parquet it is read from (measured about 3)
SHUFFLE_PER_INPUT_BYTE = 4


def apply_cluster_settings(spark: SparkSession, input_bytes: int) -> dict[str, str]:
    """Size a running session for inputs of ``input_bytes``; settings that the
    submitter chose stay. Returns what was set."""
    sized = cluster_settings(SHUFFLE_PER_INPUT_BYTE * input_bytes, spark.sparkContext.defaultParallelism)
    chosen = {k for k, _ in spark.sparkContext.getConf().getAll()}
    made = {k: v for k, v in sized.items() if k not in chosen}
    for k, v in made.items():
        spark.conf.set(k, v)
    return made
