"""Change records: kinds, tables, changed columns and routing to dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of change that carry a row's new state.
KEPT_TYPES = ("insert", "update", "bootstrap-insert")


def keep_types(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("type").isin(*KEPT_TYPES))


def new(column: str) -> Column:
    """The value after a change: of the map ``data``, or of a column where a feed with columns of its own has the alias ``data``.

    Maps are built and searched for each row, and nothing is known of what lies in them; columns keep their partitions through joins.
    """
    return F.col(f"data.`{column}`")


def old(column: str) -> Column:
    """The value before an update; null if the update did not change the column."""
    return F.col("old")[column]


def changed(column: str, from_null: bool = False) -> Column:
    """Whether an update changed the column; a change from null counts only with ``from_null``."""
    return F.map_contains_key("old", column) if from_null else old(column).isNotNull()


def moved(column: str, before: str, after: str) -> Column:
    return (old(column) == before) & (new(column) == after)


def of_database(changes: DataFrame, database: str | None) -> DataFrame:
    """The changes of one database; a feed can carry several with tables of one name. None: of all."""
    return changes if database is None else changes.where(F.col("database") == database)


def change_seconds() -> Column:
    """Source time of a change in epoch seconds; null if it is no number."""
    return F.col("ts").try_cast("long")


def set_aside(changes: DataFrame) -> DataFrame:
    """Changes without a table, a kind or a readable time: facts that need the time leave them out."""
    return changes.where(F.col("table").isNull() | F.col("type").isNull() | change_seconds().isNull())


def changes_of(
    changes: DataFrame, table: str, types: tuple[str, ...], columns: list[str], where: Column | None = None, also: list[str | Column] | None = None, database: str | None = None
) -> DataFrame:
    """The changes of one table and kind, the named columns taken out of ``data``; ``also`` are further columns."""
    rows = of_database(changes, database).where((F.col("table") == table) & F.col("type").isin(*types))
    rows = rows if where is None else rows.where(where)
    return rows.select(*(new(c).alias(c) for c in columns), *(also or []))


def cart_increments(changes: DataFrame, database: str | None = None) -> DataFrame:
    """Inserts and updates of the cart with a larger ``sku_num``; ``sku_num`` is what was added."""
    count, before = F.try_to_number(new("sku_num"), F.lit("999999999999")), F.try_to_number(old("sku_num"), F.lit("999999999999"))
    added = F.when(F.col("type") == "insert", new("sku_num")).otherwise((count - before).cast("long").cast("string"))
    columns = ["id", "user_id", "sku_id", "cart_price", "sku_name", "is_checked", "create_time", "operate_time", "is_ordered", "order_time", "source_type", "source_id"]
    return changes_of(changes, "cart_info", ("insert", "update"), columns, (F.col("type") == "insert") | (count > before), [added.alias("sku_num")], database)


def route(changes: DataFrame, config: DataFrame) -> DataFrame:
    """Changes of configured tables with their ``sink_table``, ``sink_pk`` (``id`` where none is set) and the listed columns of ``data``.

    The configuration is a table of settings, one line a dimension; Spark broadcasts it if its size allows.
    """
    rows = keep_types(changes).join(config, F.col("table") == F.col("source_table"))
    names = F.split("sink_columns", ",")
    return rows.withColumn("data", F.map_filter("data", lambda k, _: F.array_contains(names, k))).select("sink_table", F.coalesce("sink_pk", F.lit("id")).alias("sink_pk"), "type", "ts", "data")


def current_config(changes: DataFrame) -> DataFrame:
    """The configuration after all its ``before, after, op, ts_ms`` records: per source table the line of the last one, if that is no deletion (op ``d``)."""
    line = F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after"))
    last = changes.withColumn("_line", line).where("_line IS NOT NULL").groupBy("_line.source_table").agg(F.max_by(F.struct("op", "_line"), F.struct("ts_ms", "op")).alias("last"))
    return last.where("last.op <> 'd'").select("last._line.*")
