"""The behaviour log split into its five kinds, and its page views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def errors(log: DataFrame) -> DataFrame:
    """Whole records that carry an error."""
    return log.where("err IS NOT NULL")


def starts(log: DataFrame) -> DataFrame:
    return log.where("start IS NOT NULL").select("common", "start", "ts")


def pages(log: DataFrame) -> DataFrame:
    """Page views without displays and actions; a start record is no page view."""
    return log.where("start IS NULL AND page IS NOT NULL").select("common", "page", "ts")


def displays(log: DataFrame) -> DataFrame:
    """A row for each display of a page view."""
    return log.where("start IS NULL AND page IS NOT NULL AND size(displays) > 0").select("common", "page", F.explode("displays").alias("display"), "ts")


def actions(log: DataFrame, with_ts: bool = False) -> DataFrame:
    """A row for each action of a page view; the record's own ``ts`` only with ``with_ts``."""
    rows = log.where("start IS NULL AND page IS NOT NULL AND size(actions) > 0")
    return rows.select("common", "page", F.explode("actions").alias("action"), *(["ts"] if with_ts else []))


def split(log: DataFrame) -> dict[str, DataFrame]:
    return {"error": errors(log), "start": starts(log), "display": displays(log), "action": actions(log), "page": pages(log)}


#: The outputs of the log and their columns.
KINDS = {
    "error": ["common", "start", "page", "displays", "actions", "err", "ts"],
    "start": ["common", "start", "ts"],
    "display": ["common", "page", "display", "ts"],
    "action": ["common", "page", "action"],
    "page": ["common", "page", "ts"],
    "dirty": ["value"],
}


def fan_out(lines: DataFrame) -> DataFrame:
    """The five outputs and the bad lines in one pass over ``feeds.parse_lines``: a row each, with its ``kind`` and the columns of that kind, the others null."""
    columns = list(dict.fromkeys(c for names in KINDS.values() for c in names))
    element = {"display": ("displays", lines.schema["displays"].dataType.elementType), "action": ("actions", lines.schema["actions"].dataType.elementType)}
    types = {c: element[c][1] if c in element else lines.schema[c].dataType for c in columns}

    def row(kind: str, **given: Column) -> Column:
        cells = (given.get(c, F.col(c)) if c in KINDS[kind] else F.lit(None) for c in columns)
        return F.struct(F.lit(kind).alias("kind"), *(x.cast(types[c]).alias(c) for c, x in zip(columns, cells, strict=True)))

    view = F.col("good") & F.col("start").isNull() & F.col("page").isNotNull()
    none = F.array(row("dirty")).cast(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), *(T.StructField(c, types[c]) for c in columns)])))
    one = lambda where, kind: F.when(where, F.array(row(kind))).otherwise(F.slice(none, 1, 0))
    many = lambda name, kind: F.when(view & (F.size(name) > 0), F.transform(name, lambda x: row(kind, **{kind: x}))).otherwise(F.slice(none, 1, 0))
    rows = F.concat(one(~F.col("good"), "dirty"), one(F.col("good") & F.col("err").isNotNull(), "error"), one(F.col("good") & F.col("start").isNotNull(), "start"), one(view, "page"), many("displays", "display"), many("actions", "action"))
    return lines.select(F.explode(rows).alias("_row")).select("_row.*")


def of_kind(rows: DataFrame, kind: str) -> DataFrame:
    """One output of ``fan_out``."""
    return rows.where(F.col("kind") == kind).select(*KINDS[kind])


def unique_visitors(page: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """Of the page views that start a session the first per visitor and day."""
    from .keyed import first_per_day

    rows = page.where("page.last_page_id IS NULL").withColumn("_mid", F.col("common.mid")).withColumn("_rt", F.timestamp_millis("ts"))
    return first_per_day(rows, ["_mid"], "_rt", tie or []).drop("_mid", "_rt")
