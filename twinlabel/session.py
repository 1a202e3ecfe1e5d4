"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    # Joins on ids may meet a hot id; let AQE split it at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A JSON object that names a key twice keeps the last one.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Payloads and pages are large: bound the Arrow batches by bytes, not by rows only.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8388608b",
    # A file counts as this many bytes when files are dealt to tasks: 1,024 tiny ones a task, not 32.
    "spark.sql.files.openCostInBytes": "131072",
    "spark.sql.session.timeZone": "UTC",
    # State of streams lives outside the heap; state with timers needs this store.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the operators rely on; returns the session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local folder would not be seen by the executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_scratch: list[tuple[SparkSession, str]] = []


def _clear_scratch() -> None:
    for spark, path in _scratch:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone; its folder then goes with the cluster's own
            pass


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A folder as of :func:`work_dir` that is deleted when the application ends."""
    if not _scratch:
        atexit.register(_clear_scratch)
    path = work_dir(spark, purpose)
    _scratch.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever file system holds it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it is missing."""
    if not path_exists(spark, path):
        return []
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop_path)
    return sorted(f.getPath().getName() for f in found)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme and host of the file system that owns it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    owner = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return owner.makeQualified(hadoop_path).toString()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, asked of the file system that owns it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    return hadoop_path.getFileSystem(conf).exists(hadoop_path)
