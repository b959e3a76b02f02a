"""Tables that batches append to and readers see merged: parts of Parquet files and manifests that name the live ones.

A batch writes its own rows aside and then commits by renaming a manifest into place, so a batch costs what it holds, and
a reader sees a whole commit or none: a writer that stops halfway leaves files that no manifest names. Each value of the
partition columns is a part with a list of live folders, oldest first. A reader merges a part's folders; compaction merges
those of the parts that have more than ``most`` into one folder and commits that as any other change. What a manifest has
named stays until ``clean``, so readers of an older manifest go on undisturbed.

The manifest's rename must fail where the name is taken, as it does on HDFS and local disks; a table has one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import route
from ..operators.keyed import latest
from .sinks import foreach_batch, replace_latest

#: Folders of a part after which it is compacted.
MOST = 8
#: Hash buckets of a keyed table.
BUCKETS = 16


class LogTable:
    """A table of ``schema`` in parts by ``parts`` (columns of the schema), whose rows ``merge`` brings to their newest state.

    ``merge`` takes and returns rows of the schema, must give the same for rows merged before and after others, and for repeated rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, parts: list[str], merge: Callable[[DataFrame], DataFrame], most: int = MOST):
        self.spark, self.path, self.parts, self.merge, self.most = spark, path.rstrip("/"), parts, merge, most
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    # manifests

    def _hadoop(self, path: str) -> tuple:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, path: str) -> list[str]:
        place, files = self._hadoop(path)
        return sorted(x.getPath().getName() for x in files.listStatus(place)) if files.exists(place) else []

    def manifest(self) -> dict:
        """The newest one: its ``version``, the live folders by part, and the last batch of each stream that wrote."""
        names = [x for x in self._listed(f"{self.path}/_commits") if x.endswith(".json") and not x.startswith(".")]
        if not names:
            return {"version": 0, "live": {}, "batches": {}}
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/_commits/{names[-1]}").first()[0]
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        jvm = self.spark.sparkContext._jvm
        aside, files = self._hadoop(f"{self.path}/_commits/.{uuid.uuid4().hex}")
        out = files.create(aside)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        place, _ = self._hadoop(f"{self.path}/_commits/{manifest['version']:012d}.json")
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # none: an existing name is an error
        qualified = files.makeQualified(aside)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), self.spark._jsc.hadoopConfiguration()).rename(qualified, files.makeQualified(place), options)

    # rows

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Add rows; with ``batch``, a stream's name and number, only if no batch of that number or a later one is there. False: nothing was added."""
        manifest = self.manifest()
        if batch and manifest["batches"].get(batch[0], -1) >= batch[1]:
            return False
        written = self._write(self.merge(rows))
        if not written:
            return False
        live = {part: list(folders) for part, folders in manifest["live"].items()}
        for part, folder in written:
            live.setdefault(part, []).append(folder)
        batches = manifest["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._commit({"version": manifest["version"] + 1, "live": live, "batches": batches})
        return True

    def _write(self, rows: DataFrame) -> list[tuple[str, str]]:
        """Rows written aside in a folder of their own; the parts in it, each with its folder."""
        name, by = uuid.uuid4().hex, {f"by_{c}": F.col(c) for c in self.parts}
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema)).repartition(*self.parts)
        rows.withColumns(by).write.partitionBy(*by).parquet(f"{self.path}/data/{name}")
        return [(part, name) for part in self._parts_in(name)]

    def _parts_in(self, folder: str) -> list[str]:
        found = [""]
        for column in self.parts:
            found = [f"{x}/{y}".strip("/") for x in found for y in self._listed(f"{self.path}/data/{folder}/{x}") if y.startswith(f"by_{column}=")]
        return found

    def _of(self, live: dict[str, list[str]]) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/{part}" for part, folders in live.items() for folder in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, **parts: Iterable[str | int]) -> DataFrame:
        """The merged rows, of the parts with these values only; no rows if there is no commit yet."""
        wanted = [{f"by_{k}={x}" for x in values} for k, values in parts.items()]
        live = {part: folders for part, folders in self.manifest()["live"].items() if all(x & set(part.split("/")) for x in wanted)}
        return self.merge(self._of(live))

    def compact(self, most: int | None = None) -> list[str]:
        """Merge the folders of parts that have more than ``most`` into one; the parts that were."""
        manifest, most = self.manifest(), self.most if most is None else most
        full = {part: folders for part, folders in manifest["live"].items() if len(folders) > most}
        if full:
            live = {part: folders for part, folders in manifest["live"].items() if part not in full}
            for part, folder in self._write(self.merge(self._of(full))):
                live[part] = [folder]
            self._commit(manifest | {"version": manifest["version"] + 1, "live": live})
        return sorted(full)

    def clean(self, keep: int = 2) -> None:
        """Remove what none of the last ``keep`` manifests names, and the older manifests. No batch may be on its way."""
        names = [x for x in self._listed(f"{self.path}/_commits") if x.endswith(".json") and not x.startswith(".")]
        wanted: dict[str, set[str]] = {}
        for name in names[-keep:]:
            text = self.spark.read.option("wholetext", True).text(f"{self.path}/_commits/{name}").first()[0]
            for part, folders in json.loads(text)["live"].items():
                for folder in folders:
                    wanted.setdefault(folder, set()).add(part)
        gone = [f"_commits/{x}" for x in names[:-keep]]
        for folder in self._listed(f"{self.path}/data"):
            gone += [f"data/{folder}/{x}" for x in self._parts_in(folder) if x not in wanted[folder]] if folder in wanted else [f"data/{folder}"]
        for x in gone:
            place, files = self._hadoop(f"{self.path}/{x}")
            files.delete(place, True)


def _bucket(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


# dimensions


class Dimensions:
    """Dimension tables in one log: each row sets one column of one key, with the time of the change.

    A key's columns keep their last values in the order of times and then kinds of change; late and repeated batches do no harm.
    """

    SCHEMA = "sink_table string, bucket int, pk string, column string, at struct<ts: bigint, type: string>, value string"

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, most: int = MOST):
        self.buckets, self.log = buckets, LogTable(spark, path, self.SCHEMA, ["sink_table", "bucket"], self._newest, most)

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        last = rows.groupBy("sink_table", "bucket", "pk", "column").agg(F.max(F.struct("at", "value")).alias("last"))
        return last.select("sink_table", "bucket", "pk", "column", "last.at", "last.value")

    def append(self, routed: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Add routed changes (``sink_table, sink_pk, type, ts, data``) of any number of tables in one write; changes without a key go.

        A change sets the columns that it names and that are not null; the key's own column says that it is there.
        """
        pk = F.col("data")[F.col("sink_pk")]
        at = F.struct(F.col("ts").try_cast("long").alias("ts"), "type").alias("at")
        rows = routed.where(pk.isNotNull()).select("sink_table", _bucket(pk, self.buckets).alias("bucket"), pk.alias("pk"), at, F.explode("data").alias("column", "value"))
        return self.log.append(rows.where("value IS NOT NULL"), batch)

    def table(self, name: str, key: str, columns: list[str], versions: bool = False) -> DataFrame:
        """A dimension as readers see it: its key and columns; with ``versions`` each column as ``(at, value)``, as ``sinks.column_versions`` gives."""
        rows = self.log.read(sink_table=[name])
        cell = {c: F.max(F.when(F.col("column") == c, F.struct("at", "value"))) for c in columns}
        found = rows.groupBy(F.col("pk").alias(key)).agg(F.lit(1).alias("_"), *(x.alias(c) for c, x in cell.items()))
        return found.select(key, *columns) if versions else found.select(key, *(F.col(f"`{c}`.value").alias(c) for c in columns))

    def of(self, line: Row, versions: bool = False) -> DataFrame:
        """The dimension of a line of the configuration."""
        key = line["sink_pk"] or "id"
        return self.table(line["sink_table"], key, [c for c in line["sink_columns"].split(",") if c != key], versions)


def dimension_stream(changes: DataFrame, config: Callable[[], DataFrame], store: Dimensions, checkpoint: str, name: str = "changes", available_now: bool = False) -> StreamingQuery:
    """Keep the configured dimensions of a stream of changes; every batch asks ``config`` anew, so lines can come and go.

    A batch writes its own changes once, for all tables together, and then compacts what has grown past the bound; a replayed one changes nothing.
    """

    def work(batch: DataFrame, number: int) -> None:
        store.append(route(batch, config()), (name, number))
        store.log.compact()

    return foreach_batch(changes, checkpoint, work, available_now)


def bucketed(rows: DataFrame, table: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """A dimension saved as a table in buckets by its key and read back; facts that are joined to it on the key move to its buckets, and it stays."""
    rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return rows.sparkSession.table(table)


# summaries


def summaries(spark: SparkSession, path: str, schema: T.StructType, dims: list[str], most: int = MOST) -> LogTable:
    """A summary's windows by day, each in its newest version; ``schema`` is that of ``sinks.versioned``."""

    def newest(rows: DataFrame) -> DataFrame:
        return replace_latest(rows, dims).select(*schema.names)

    return LogTable(spark, path, schema, ["dt"], newest, most)


def log_stream(rows: DataFrame, table: LogTable, checkpoint: str, name: str = "rows", available_now: bool = False) -> StreamingQuery:
    """Keep a stream in a log table, such as that of ``summaries`` or ``last_rows``; parts with many folders are compacted on the way, and a replayed batch changes nothing."""

    def work(batch: DataFrame, number: int) -> None:
        table.append(batch, (name, number))
        table.compact()

    return foreach_batch(rows, checkpoint, work, available_now)


# last rows by key


def last_rows(spark: SparkSession, path: str, schema: T.StructType | str, key: list[str], order: list[str], partition: str, most: int = MOST) -> LogTable:
    """A table of the last row per key by ``order``, in parts by ``partition``, a column that a key keeps; a batch writes its own rows only."""
    return LogTable(spark, path, schema, [partition], lambda rows: latest(rows, [partition, *key], order), most)


# first days


class FirstDays:
    """The first day that each key was seen on, kept from batch to batch; batches can come in any order.

    A batch reads the buckets of its own keys only, and writes the keys whose first day it changes: one without new keys writes nothing.
    """

    SCHEMA = "bucket int, key string, first date"

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, most: int = MOST):
        self.buckets, self.log = buckets, LogTable(spark, path, self.SCHEMA, ["bucket"], self._merged, most)

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("bucket", "key").agg(F.min("first").alias("first"))

    def add(self, rows: DataFrame, key: str, day: Column, batch: tuple[str, int] | None = None) -> bool:
        """Take the days of the keys in ``rows`` in; False: they change nothing. Rows without a key or a day are no one's."""
        text = F.col(key).cast("string")
        seen = rows.where(text.isNotNull() & day.isNotNull()).select(_bucket(text, self.buckets).alias("bucket"), text.alias("key"), day.alias("first"))
        seen = self._merged(seen)
        met = [r["bucket"] for r in seen.select("bucket").distinct().collect()]  # at most ``buckets``
        known = self.log.read(bucket=met).select("bucket", "key", F.col("first").alias("_known"))
        changed = seen.join(known, ["bucket", "key"], "left").where(F.col("_known").isNull() | (F.col("first") < F.col("_known")))
        return self.log.append(changed.select("bucket", "key", "first"), batch)

    def known(self) -> DataFrame:
        """``(key, first)``."""
        return self.log.read().select("key", "first")

    def flagged(self, rows: DataFrame, key: str, time: str, tie: list[str], new: str) -> DataFrame:
        """Rows with ``new`` 1 on their key's first row of its first day by this table, else 0; of a batch no other day is read but its own.

        The keys' rows of that day must be in ``rows`` and have been taken in by ``add``.
        """
        firsts = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(time, *tie)).alias("_least"))
        known = self.known().select(F.col("key").alias("_known"), "first")
        firsts = firsts.join(known, F.col("_key").cast("string") == F.col("_known")).where(F.to_date(f"_least.{time}") == F.col("first")).select("_key", "_least")
        same = (F.col(key) == F.col("_key")) & (F.struct(time, *tie) == F.col("_least"))
        return rows.join(firsts, same, "left").withColumn(new, F.col("_key").isNotNull().cast("long")).drop("_key", "_least")
