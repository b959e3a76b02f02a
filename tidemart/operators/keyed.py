"""Work that remembers a value per key, as window functions over a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(order: list[str | Column], descending: bool) -> list[Column]:
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    return [c.desc_nulls_last() if descending else c.asc_nulls_first() for c in columns]


def _nth(rows: DataFrame, key: list[str | Column], by: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where("_n = 1").drop("_n")


def first(rows: DataFrame, key: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row per key."""
    return _nth(rows, key, _ordered(order, False))


def latest(rows: DataFrame, key: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The last row per key; among equal times the one that comes last in the rest of ``order``."""
    return _nth(rows, key, _ordered(order, True))


def first_per_day(rows: DataFrame, key: list[str], time: str, tie: list[str]) -> DataFrame:
    """The first row per key and day of ``time``; rows with a null key are no one's and go."""
    return first(rows.dropna(subset=key), [*key, F.to_date(time)], [time, *tie])


def fix_is_new(log: DataFrame, backfill: bool = False) -> DataFrame:
    """The log with ``common.is_new`` set to '0' on days after a visitor's first day as new.

    With ``backfill`` a record that already says '0' makes every later one of its visitor old, too. Both first times are
    partial aggregates that are joined back: no task sorts a visitor's records. Records without a visitor stay as they are.
    """
    day, new = F.to_date(F.timestamp_millis("ts")), F.col("common.is_new") == "1"
    firsts = log.where("common.mid IS NOT NULL").groupBy(F.col("common.mid").alias("_mid")).agg(F.min(F.when(new, day)).alias("_day"), F.min(F.when(~new, F.col("ts"))).alias("_old"))
    old = day > F.col("_day")
    if backfill:
        old = F.coalesce(old, F.lit(False)) | F.coalesce(F.col("_old") <= F.col("ts"), F.lit(False))
    rows = log.join(firsts, F.col("common.mid") == F.col("_mid"), "left")
    flag = F.when(new & F.coalesce(old, F.lit(False)), "0").otherwise(F.col("common.is_new"))
    return rows.withColumn("_new", flag).withColumn("common", F.col("common").withField("is_new", F.col("_new"))).select(*log.columns)


#: Milliseconds of the stretches in which a visitor's page views are put in order.
STRETCH_MS = 3_600_000


def with_next(pages: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """Page views with the time ``_next`` of their visitor's next one, and whether that ``_starts`` a session.

    A task puts one visitor's views of one hour in order; the first view of each hour is handed to the hour before it.
    """
    rows = pages.where("common.mid IS NOT NULL").withColumn("_mid", F.col("common.mid")).withColumn("_hour", F.floor(F.col("ts") / STRETCH_MS)).withColumn("_start", F.col("page.last_page_id").isNull())
    order = ["ts", *(tie or [])]
    firsts = rows.groupBy("_mid", "_hour").agg(F.min_by(F.struct("ts", "_start"), F.struct(*order)).alias("_first"))
    firsts = firsts.select("_mid", "_hour", F.lead("_first").over(Window.partitionBy("_mid").orderBy("_hour")).alias("_later"))
    w = Window.partitionBy("_mid", "_hour").orderBy(*order)
    rows = rows.join(firsts, ["_mid", "_hour"])
    after = {"_next": F.coalesce(F.lead("ts").over(w), F.col("_later.ts")), "_starts": F.coalesce(F.lead("_start").over(w), F.col("_later._start"))}
    return rows.withColumns(after).select(*pages.columns, "_start", "_next", "_starts")


def bounced(limit_ms: int) -> Column:
    """Of rows of ``with_next``: session starts whose visitor's next page starts a session, comes ``limit_ms`` later or not at all."""
    return F.col("_start") & (F.col("_next").isNull() | F.col("_starts") | (F.col("_next") - F.col("ts") >= limit_ms))


def bounces(pages: DataFrame, limit_ms: int = 10_000, tie: list[str] | None = None) -> DataFrame:
    """Session starts (no last page) whose visitor's next page starts a session, comes ``limit_ms`` later or not at all; views without a visitor go."""
    return with_next(pages, tie).where(bounced(limit_ms)).select(*pages.columns)


def daily_logins(pages: DataFrame, tie: list[str] | None = None, away_days: int = 7) -> DataFrame:
    """A row per user and day of login with ``uu_ct`` 1, and ``back_ct`` 1 if the login before was over ``away_days`` ago."""
    login = F.col("common.uid").isNotNull() & (F.col("page.last_page_id").isNull() | (F.col("page.last_page_id") == "login"))
    rows = pages.where(login).withColumn("uid", F.col("common.uid")).withColumn("rt", F.timestamp_millis("ts"))
    rows = first_per_day(rows, ["uid"], "rt", tie or [])
    before = F.lag(F.to_date("rt")).over(Window.partitionBy("uid").orderBy("rt"))
    back = F.coalesce(F.datediff(F.to_date("rt"), before) > away_days, F.lit(False)).cast("long")
    return rows.select("uid", "rt", F.lit(1).cast("long").alias("uu_ct"), back.alias("back_ct"))


def unique_and_new(rows: DataFrame, user: str, time: str, tie: list[str], unique: str, new: str, partitions: int | None = None) -> DataFrame:
    """Rows with flags: ``unique`` 1 on a user's first row of a day, ``new`` 1 on the user's first row ever.

    The first row ever is the first one of the first day: only the first rows of a user's days meet each other, the others stay
    with their day, so a task orders one user's rows of one day only, and the rows are made once. Rows without a user or a time
    are the first of nothing. ``partitions`` are those of long tables; None leaves them to Spark.
    """
    own = F.coalesce(F.col(user).cast("string"), F.concat(F.lit("\0"), F.xxhash64(time, *tie).cast("string")))  # rows without a user stay apart
    out = rows.withColumns({"_own": own, "_day": F.to_date(time)})
    out = out.repartition(partitions, "_own", "_day") if partitions else out
    n = F.row_number().over(Window.partitionBy("_own", "_day").orderBy(F.col(time), *map(F.col, tie)))
    out = out.withColumn("_first", F.coalesce(F.when(F.col(user).isNotNull() & F.col("_day").isNotNull(), n) == 1, F.lit(False)))
    out = out.withColumn("_rest", F.when(~F.col("_first"), F.coalesce(F.col("_day").cast("string"), F.lit(""))))  # null: the first rows of days
    out = out.repartition(partitions, "_own", "_rest") if partitions else out
    ever = F.min("_day").over(Window.partitionBy("_own", "_rest")) == F.col("_day")
    return out.withColumns({unique: F.col("_first").cast("long"), new: (F.col("_first") & ever).cast("long")}).drop("_own", "_day", "_first", "_rest")
