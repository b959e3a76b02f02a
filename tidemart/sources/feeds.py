"""Readers of the two feeds, of landed tables and of the code dictionary, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CHANGE, DICTIONARY, LOG

#: Codes of a dictionary that joins may broadcast (some 10 MB).
BROADCAST_CODES = 100_000


def read_raw(spark: SparkSession, path: str | None = None, fmt: str = "text", streaming: bool = False, **options: str) -> DataFrame:
    """Records as one string column ``value``: text files, or a topic with ``fmt='kafka'`` and its options."""
    reader = (spark.readStream if streaming else spark.read).format(fmt).options(**options)
    if fmt == "text":
        reader = reader.schema("value string")
    raw = reader.load(path) if path else reader.load()
    return raw.select(F.col("value").cast("string").alias("value"))


def parse_changes(raw: DataFrame) -> DataFrame:
    """Change records ``database, table, type, ts, data, old`` from JSON; what is no JSON object is dropped."""
    row = F.from_json("value", CHANGE)
    return raw.select(row.alias("r")).where("r.`table` IS NOT NULL").select("r.*")


def parse_lines(raw: DataFrame) -> DataFrame:
    """Every line with its ``value``, whether it is ``good``, and the columns of a behaviour log record; JSON is parsed once.

    A line that is no JSON object or has no ``common.mid`` or ``ts`` is not good.
    """
    schema = T.StructType([*LOG.fields, T.StructField("_corrupt", T.StringType())])
    row = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    good = F.col("r._corrupt").isNull() & F.col("r.common.mid").isNotNull() & F.col("r.ts").isNotNull()
    return raw.select("value", row.alias("r")).select("value", F.coalesce(good, F.lit(False)).alias("good"), *(F.col(f"r.{f.name}") for f in LOG))


def parse_log(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Behaviour log records, and the raw lines that do not parse; a line without ``common`` or ``ts`` is of the second kind.

    JSON is parsed once per output; ``logs.fan_out`` gives both in one pass.
    """
    parsed = parse_lines(raw)
    return parsed.where("good").select(*LOG.names), parsed.where("NOT good").select("value")


def read_table(spark: SparkSession, path: str, schema: T.StructType, streaming: bool = False, fmt: str = "parquet") -> DataFrame:
    """A landed table with its declared schema; rows without any value (tombstones) are dropped."""
    rows = (spark.readStream if streaming else spark.read).schema(schema).format(fmt).load(path)
    return rows.dropna("all")


def read_dictionary(spark: SparkSession, path: str | None = None, **jdbc: str) -> DataFrame:
    """The code dictionary from files, or over JDBC with its options (url, dbtable, user, ...).

    It is counted: up to ``BROADCAST_CODES`` codes are broadcast to the joins, since Spark cannot know a JDBC table's size and
    would else shuffle facts by a handful of codes; a larger one is joined as Spark sees fit.
    """
    rows = spark.read.format("jdbc").options(**jdbc).load() if jdbc else spark.read.schema(DICTIONARY).parquet(path)
    rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in DICTIONARY))
    return F.broadcast(rows) if rows.count() <= BROADCAST_CODES else rows
