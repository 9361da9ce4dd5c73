"""Session settings and the shared working folder."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# The state store every stateful operator in kgspark.streaming needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "kgspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect. Cluster settings passed by spark-submit win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is used, which is only right when driver and
    executors are one machine; on a cluster the missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="kgspark-")
        spark.conf.set("spark.checkpoint.dir", named)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


def bounded_batches(spark: SparkSession) -> None:
    """Keeps the Arrow batches of wide rows small, where the session does not say otherwise.

    With Spark's default of 10,000 rows a batch of long texts or records takes gigabytes, in the JVM and again
    in Python.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "16m"))


def staging_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/kgspark/{name}-{uuid.uuid4().hex[:12]}"


def stored(frame: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The frame as a table in the shared folder: later steps read it, and do not recompute it.

    What was written survives the loss of executors, and reads prune its columns.
    """
    target = path or staging_path(frame.sparkSession, name)
    frame.write.parquet(target)
    return frame.sparkSession.read.schema(frame.schema).parquet(target)


@contextmanager
def fixed_tasks(spark: SparkSession, readers: int, mergers: int) -> Iterator[None]:
    """Jobs inside read files in so many tasks at least, and each of their shuffles ends in just so many.

    For a job whose rows were counted: the session's own number of shuffle partitions does not grow with them.
    """
    settings = {
        "spark.sql.files.minPartitionNum": str(readers),
        "spark.sql.shuffle.partitions": str(mergers),
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``stored`` that no frame reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Staging:
    """Tables of ``stored`` that lie in the shared folder only until ``clear``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, frame: DataFrame, name: str) -> DataFrame:
        self.paths.append(staging_path(self.spark, name))
        return stored(frame, name, self.paths[-1])

    def clear(self) -> None:
        """Delete them; no frame may read them any more."""
        while self.paths:
            discard(self.spark, self.paths.pop())


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now.

    It does so for frames that nobody holds any more, but only once the driver's garbage is collected, which
    may be half an hour later; call it after a large step whose result is a table.
    """
    gc.collect()
    for _ in range(2):  # what the first round frees lets go of the rest
        time.sleep(1)  # by then the bridge to the JVM has dropped what Python has
        spark.sparkContext._jvm.System.gc()
