"""Spark session construction and cluster-level settings."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. Time zone is pinned so that date parts of
# timestamp_ntz columns and of SQL oracles agree; AQE re-plans joins and
# coalesces small shuffle partitions at run time, and splits skewed joins.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Defaults for a large cluster (e.g. ~1000 executors over ~100 TB). Applied by
# :func:`apply_cluster_defaults` only where the cluster has no value:
# start with many shuffle partitions and let AQE coalesce them to ~256 MB,
# split skewed partitions of joins, read files in 256 MB splits, and keep
# the automatic broadcast small (AQE checks runtime sizes against it).
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "16000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.shuffle.partitions": "4000",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
}


def apply_cluster_defaults(spark: SparkSession, conf: dict | None = None) -> dict:
    """Set the large-cluster defaults that the session does not define yet.

    Returns the settings that were applied; existing values are kept.
    """
    given = {k for k, _ in spark.sparkContext.getConf().getAll()}
    applied = {}
    for k, v in (conf or CLUSTER_CONF).items():
        if k not in given:
            spark.conf.set(k, v)
            applied[k] = v
    return applied


def get_session(master: str | None = None, app: str = "blotter",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Return (or create) a session.

    On a cluster ``master`` stays ``None``: what the submitter has set stays as
    it is, :data:`CLUSTER_CONF` fills in the rest. Locally pass e.g.
    ``local[8]``: :data:`BASE_CONF`, ``shuffle_partitions`` and ``extra`` apply.
    """
    if master is None:
        builder = SparkSession.builder.appName(app)
        for k, v in (extra or {}).items():
            builder = builder.config(k, v)
        spark = builder.getOrCreate()
        apply_cluster_defaults(spark)
        return spark
    conf = {**BASE_CONF, "spark.driver.memory": os.environ.get("BLOTTER_DRIVER_MEMORY", "8g")}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    builder = SparkSession.builder.appName(app).master(master)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    The cluster's setting, or the context's checkpoint folder. Where neither is
    set, a local master gets a fresh scratch folder; any other raises, since a
    folder of one machine would lose what the other executors write.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        current = current.get() if current.isDefined() else None
    if not current:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="blotter-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, kind: str, name: str) -> str:
    """A new path ``kind/name-<random>`` in the shared checkpoint folder, which
    :func:`drop_scratch` deletes. Everything that a job writes there goes to such a path."""
    path = os.path.join(checkpoint_dir(spark), kind, f"{name}-{uuid.uuid4().hex}")
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df, name: str = "table", **options):
    """Write ``df`` once as a Parquet table in the shared checkpoint folder and
    read it back, cutting the lineage.

    Used before multi-pass consumers (ML fitting, exact quantiles) so they do
    not recompute a long plan per pass. Unlike an uncached
    ``Dataset.checkpoint`` (which runs the plan twice) the plan runs once; the
    files are reliable storage, so a lost executor does not lose them. They
    belong to the job: :func:`drop_scratch` deletes them when its results are
    written. ``options`` are the Parquet writer's, e.g. ``compression``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "tables", name)
    df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.parquet(path)


_WRITTEN: dict[str, list[str]] = {}


def drop_scratch(spark: SparkSession) -> int:
    """Delete what this application has written under :func:`scratch_path` (tables,
    models, logs, streams, archives); frames that read them are no longer usable.
    Returns the number of paths."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    return len(paths)
