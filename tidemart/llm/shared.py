"""Tables kept between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes in a batch that goes to Python.
BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20

_OWN: dict[str, str] = {}
#: Paths of the tables that ``scratch`` blocks have landed so far.
_SCRATCH: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a new temporary folder only where that is unset and driver and tasks are one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-")
    return _OWN[app]


def bounded_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of about BATCH_BYTES at most, whatever the length of their texts.

    A smaller number of rows and any number of bytes that the session has set stay.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    if spark.conf.get(size, None) is None:
        spark.conf.set(size, BATCH_BYTES)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corpus/{name}-{uuid.uuid4().hex}"


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that are done: it does so when the driver collects their handles."""
    spark.sparkContext._jvm.java.lang.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that are landed inside the block, but for kept ones, at its end: nothing that outlives it may read them."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for path in _SCRATCH.pop():
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        free_shuffles(spark)


def land(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it as read back; ``keep`` it beyond a ``scratch`` block.

    The plan restarts from files that survive lost executors, and joins on it see true sizes.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
