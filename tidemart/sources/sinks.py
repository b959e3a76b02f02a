"""Append, keyed and versioned sinks."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.keyed import latest


def as_topic(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as JSON in ``value``, with an optional ``key``, as a topic sink takes them."""
    value = F.to_json(F.struct("*")).alias("value")
    return df.select(value) if key is None else df.select(F.col(key).cast("string").alias("key"), value)


def append_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = False, **options: str) -> StreamingQuery:
    """Append a stream to files or a topic."""
    writer = df.writeStream.outputMode("append").format(fmt).option("checkpointLocation", checkpoint).options(**options)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start(path) if fmt != "kafka" else writer.start()


def upsert(old: DataFrame | None, new: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key: of the old and new rows the last by ``order``."""
    rows = new if old is None else old.unionByName(new, allowMissingColumns=True)
    return latest(rows, key, order)


def partial_upsert(changes: DataFrame, key: list[str], columns: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key from rows that each set only their non-null columns: every column takes its last value set."""
    return current(column_versions(changes, key, columns, order), key, columns)


def column_versions(changes: DataFrame, key: list[str], columns: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key with, for each column, its last value set and when: ``(at, value)``; null if it was never set."""
    at = F.struct(*(F.col(c) if isinstance(c, str) else c for c in order)).alias("at")
    return changes.groupBy(*key).agg(*(F.max(F.when(F.col(c).isNotNull(), F.struct(at, F.col(c).alias("value")))).alias(c) for c in columns))


def merge_versions(stored: DataFrame | None, new: DataFrame, key: list[str]) -> DataFrame:
    """Two tables of ``column_versions`` as one: each column keeps its later value. The order of merges is all the same, and a replay changes nothing."""
    if stored is None:
        return new
    both = stored.unionByName(new, allowMissingColumns=True)
    return both.groupBy(*key).agg(*(F.max(c).alias(c) for c in both.columns if c not in key))


def current(versions: DataFrame, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """What readers see of a table of ``column_versions``: the values."""
    return versions.select(*key, *(F.col(f"{c}.value").alias(c) for c in columns or [c for c in versions.columns if c not in key]))


def read_stored(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """A Parquet table, or None if there is none yet."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _cut(rows: DataFrame) -> DataFrame:
    """The rows as files of the checkpoint folder, which a table that is read and written needs; the folder must be set, but for one machine."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return rows.checkpoint()


def replace_partitions(spark: SparkSession, path: str, new: DataFrame, key: list[str], order: list[str | Column], partition: str) -> None:
    """Merge ``new`` into a table partitioned by ``partition``: only the partitions that it touches are read and written."""
    new = _cut(new)
    stored = read_stored(spark, path, new.schema)
    if stored is not None:  # a semi join on the partition, which prunes the files of the others
        stored = stored.join(new.select(partition).distinct(), partition, "left_semi")
    merged = _cut(upsert(stored, new, key, order))  # the files read are the ones written
    merged.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def upsert_stream(df: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str], partition: str, available_now: bool = False) -> StreamingQuery:
    """Keep the last row per key of a stream in a table; a batch that is replayed changes nothing."""
    return foreach_batch(df, checkpoint, lambda batch, _: replace_partitions(batch.sparkSession, path, batch, key, order, partition), available_now)


def foreach_batch(df: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], available_now: bool = False) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def to_jdbc(batch: DataFrame, **options: str) -> None:
    batch.write.format("jdbc").options(**options).mode("append").save()


def append_versions(batch: DataFrame, path: str) -> None:
    """Append ``versioned`` rows to their days. A replayed batch adds the same rows, of which ``replace_latest`` shows one."""
    batch.write.mode("append").partitionBy("dt").parquet(path)


def versions_stream(df: DataFrame, columns: list[str], ts: Column, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Window results of a stream as ``versioned`` rows in day partitions."""
    return foreach_batch(versioned(df, columns, ts), checkpoint, lambda batch, _: append_versions(batch, path), available_now)


def versioned(df: DataFrame, columns: list[str], ts: Column) -> DataFrame:
    """Window results in the sink's column order, with their version and day."""
    return df.select("stt", "edt", *columns, ts.alias("ts")).withColumn("dt", F.to_date("stt"))


def replace_latest(versions: DataFrame, dims: list[str]) -> DataFrame:
    """What readers see of re-sent windows: per window and dimensions the row of the largest ``ts``."""
    rest = [c for c in versions.columns if c not in ("stt", "edt", *dims)]
    last = versions.groupBy("stt", "edt", *dims).agg(F.max_by(F.struct(*rest), "ts").alias("last"))
    return last.select("stt", "edt", *dims, "last.*")
