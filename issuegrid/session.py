"""Spark session settings shared by the library, the tests and the bench.

The library never creates a session on its own inside an operator; callers pass one
in. ``get_session`` is a convenience for scripts and tests.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC for repeatable timestamps, AQE for runtime
# re-planning (broadcast by measured size, partition coalescing, skew splitting).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Streaming state is one row per issue: keep it in RocksDB, not on the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# Starting points for a large cluster (not applied unless asked for): many initial
# shuffle partitions that AQE coalesces to ~256 MB each, 256 MB scan splits, and
# skew splitting from 5x the median partition.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.sources.bucketing.enabled": "true",
    # Size estimates from compressed Parquet bytes are low; scale them up so the
    # planner's static broadcast choice stays on the safe side.
    "spark.sql.sources.fileCompressionFactor": "4.0",
}


def get_session(
    master: str | None = None,
    app_name: str = "issuegrid",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
    cluster: bool = False,
) -> SparkSession:
    """Build (or reuse) a session with :data:`BASE_CONF` (and, with ``cluster``,
    :data:`CLUSTER_CONF`) applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if cluster:
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    for key, value in conf.items():
        if not key.startswith("spark.ui") and not key.startswith("spark.driver"):
            try:
                spark.conf.set(key, value)
            except Exception:  # static conf already fixed by an existing session
                pass
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must come from the session (a shared file system);
    an unset value is an error there. Only for a local master — tests, the
    bench — a folder is made under ``fallback`` (or a fresh temporary folder).
    The folder is also registered as the SparkContext checkpoint directory.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/object store) for this cluster")
        path = fallback or tempfile.mkdtemp(prefix="issuegrid-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.removeprefix("file:")
