"""Session helpers: one place for the settings every operator relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Sizing for a large cluster (e.g. 1000 executors, ~100 TB input): many
# shuffle partitions that AQE coalesces to ~256 MB, skewed partitions split
# by AQE, 256 MB scan splits. Passed as ``cluster=True``.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "riskstream",
              shuffle_partitions: int | None = None, cluster: bool = False) -> SparkSession:
    """Create (or reuse) a session with UTC time, AQE and the UI off.

    On a cluster, ``master`` stays ``None`` so that spark-submit decides,
    and ``cluster=True`` applies ``CLUSTER_CONF``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.sql.streaming.stateStore.providerClass",
                  "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"))
    if cluster:
        for k, v in CLUSTER_CONF.items():
            b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    ensure_utc(spark)
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """All operators work in UTC event time (hour and weekday included)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


_OWN_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and state tables, the same for a whole
    session and for the next one that is given it.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    and Spark runs locally (tests, a laptop) a scratch folder takes its place.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _OWN_DIRS:
        _OWN_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="riskstream-ckpt-")
    return _OWN_DIRS[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    return f"{checkpoint_dir(spark)}/{name}"


def written(d: DataFrame, name: str) -> DataFrame:
    """The frame as a table of the shared folder, for what reads it in several passes."""
    path = scratch_path(d.sparkSession, f"{name}-{uuid.uuid4().hex}")
    d.write.parquet(path)
    return d.sparkSession.read.schema(d.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder, if it is there."""
    p, fs = _file_system(spark, path)
    fs.delete(p, True)


def list_path(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of the shared folder; none if it is not there."""
    p, fs = _file_system(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (UDF / applyInPandas
    closures pickle its functions by reference). Zips the package once per
    SparkContext and adds it with ``addPyFile``; a no-op when the package
    is already installed on the executors' Python path."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="riskstream-pkg-"), "riskstream.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg_dir):
            if "__pycache__" in d:
                continue
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(d, f)
                    z.write(p, os.path.relpath(p, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
