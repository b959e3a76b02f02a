"""Summaries over tumbling windows.

Every summary takes rows with an event time ``rt`` (batch, or a stream with a watermark) and gives ``stt, edt``, its
dimensions and its measures. ``width`` is the window's width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import explode_words
from ..functions.times import bounds
from .dims import name_of
from .keyed import bounced, with_next

WIDTH = "10 seconds"
ON_TIME = "0 seconds"
_MONEY = "decimal(38,6)"


def summarize(rows: DataFrame, width: str, dims: list[str], *measures: Column, late: str = ON_TIME) -> DataFrame:
    """Sums by window of ``rt``; ``late`` is how much ``rt`` was put off by a step before, the windows are those of the events."""
    grouped = rows.groupBy(F.window("rt", width, width, late).alias("window"), *dims).agg(*measures)
    if late != ON_TIME:
        ends = (F.expr(f"window.{end} - INTERVAL {late}").alias(end) for end in ("start", "end"))
        grouped = grouped.withColumn("window", F.struct(*ends))
    return grouped.select(*bounds(), *[c for c in grouped.columns if c != "window"])


def _sums(*names: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def _order_sums(rows: DataFrame, width: str, dims: list[str], count: str, late: str, amount: bool = True) -> DataFrame:
    """Distinct orders, and their amounts, by window.

    A batch counts them in one aggregate. A stream first sums up each order by itself and counts the orders of a window once that has
    closed, so that a row of state holds one order or one window's sums, however many orders a key has.
    """
    number = F.col("split_total_amount").try_cast("decimal(18,4)") if amount else F.lit(None).cast("decimal(18,4)")  # amounts that are no numbers count as none
    if rows.isStreaming:
        rows = rows.groupBy(F.window("rt", width, width, late).alias("_window"), *dims, "order_id").agg(F.sum(number).alias("_amount"))
        rows, number = rows.withColumn("rt", F.window_time("_window")), F.col("_amount")
    orders = (F.count if rows.isStreaming else F.count_distinct)("order_id").alias(count)
    return summarize(rows, width, dims, orders, *([F.sum(number).cast(_MONEY).alias("order_amount")] if amount else []), late=late)


def searches(page: DataFrame) -> DataFrame:
    """Search texts of page views."""
    hits = (F.col("page.last_page_id") == "search") & (F.col("page.item_type") == "keyword") & F.col("page.item").isNotNull()
    return page.where(hits).select(F.timestamp_millis("ts").alias("rt"), F.col("page.item").alias("text"))


def keyword(words: DataFrame, width: str = WIDTH, lexicon: list[str] | None = None, fine: bool = False) -> DataFrame:
    rows = explode_words(words, "text", lexicon=lexicon, fine=fine)
    return summarize(rows.withColumn("source", F.lit("SEARCH")), width, ["source", "keyword"], F.count(F.lit(1)).alias("keyword_count"))


def traffic_rows(page: DataFrame, visitors: DataFrame, jumps: DataFrame) -> DataFrame:
    """One row for each page view, unique visitor and bounce, the measures of the other two zero."""
    session = F.col("page.last_page_id").isNull().cast("long")
    kinds = [
        (visitors, {"uv_ct": F.lit(1)}),
        (page, {"sv_ct": session, "pv_ct": F.lit(1), "dur_sum": F.coalesce("page.during_time", F.lit(0))}),
        (jumps, {"uj_ct": F.lit(1)}),
    ]
    names = ["uv_ct", "sv_ct", "pv_ct", "dur_sum", "uj_ct"]
    parts = [
        rows.select(F.timestamp_millis("ts").alias("rt"), *(F.col(f"common.{c}") for c in ("vc", "ch", "ar", "is_new")), *(made.get(n, F.lit(0)).cast("long").alias(n) for n in names))
        for rows, made in kinds
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def traffic_flags(page: DataFrame, limit_ms: int = 10_000, tie: list[str | Column] | None = None) -> DataFrame:
    """What ``traffic_rows`` sums up, as one row for each page view of a batch; no task orders more than a visitor's day.

    ``tie`` tells views of one visitor and time apart.
    """
    mid, day = F.col("common.mid"), F.to_date(F.timestamp_millis("ts"))
    first = F.col("_start") & (F.row_number().over(Window.partitionBy(mid, day, "_start").orderBy("ts", *(tie or []))) == 1)
    return with_next(page, tie).withColumns({"_unique": first, "_jump": bounced(limit_ms)}).select(
        F.timestamp_millis("ts").alias("rt"), *(F.col(f"common.{c}") for c in ("vc", "ch", "ar", "is_new")),
        F.col("_unique").cast("long").alias("uv_ct"), F.col("_start").cast("long").alias("sv_ct"), F.lit(1).cast("long").alias("pv_ct"),
        F.coalesce("page.during_time", F.lit(0)).cast("long").alias("dur_sum"), F.col("_jump").cast("long").alias("uj_ct"),
    )


def traffic(rows: DataFrame, width: str = WIDTH) -> DataFrame:
    return summarize(rows, width, ["vc", "ch", "ar", "is_new"], *_sums("uv_ct", "sv_ct", "pv_ct", "dur_sum", "uj_ct"))


def page_view(firsts: DataFrame, width: str = WIDTH) -> DataFrame:
    """From the first home and detail page views per visitor and day."""
    kinds = [F.sum((F.col("page_id") == p).cast("long")).alias(n) for p, n in (("home", "home_uv_ct"), ("good_detail", "good_detail_uv_ct"))]
    return summarize(firsts, width, [], *kinds)


def user_login(logins: DataFrame, width: str = WIDTH) -> DataFrame:
    return summarize(logins, width, [], *_sums("back_ct", "uu_ct"))


def user_register(rows: DataFrame, width: str = WIDTH) -> DataFrame:
    return summarize(rows, width, [], F.count(F.lit(1)).alias("register_ct"))


def cart_add(firsts: DataFrame, width: str = WIDTH) -> DataFrame:
    return summarize(firsts, width, [], F.count(F.lit(1)).alias("cart_add_uu_ct"))


def payment(flagged: DataFrame, width: str = WIDTH, late: str = ON_TIME) -> DataFrame:
    return summarize(flagged, width, [], *_sums("payment_suc_unique_user_count", "payment_new_user_count"), late=late)


def _trade_amounts() -> dict[str, Column]:
    """What ``trade_order`` sums up, from a detail's texts; amounts that are no numbers count as none."""
    money = lambda c: F.coalesce(F.col(c).try_cast("decimal(18,4)"), F.lit(0))
    return {
        "order_activity_reduce_amount": money("split_activity_amount"), "order_coupon_reduce_amount": money("split_coupon_amount"),
        "order_origin_total_amount": F.col("order_price").try_cast("decimal(18,2)") * F.col("sku_num").try_cast("decimal(12,2)"),
    }


def trade_orders(details: DataFrame) -> DataFrame:
    """Details of a batch as one row for each user, time and order, with the smallest ``id``: flags and ``trade_order`` come out the same."""
    return details.groupBy("order_id", "user_id", "rt").agg(F.min("id").alias("id"), *(F.sum(c).alias(name) for name, c in _trade_amounts().items()))


def trade_order(flagged: DataFrame, width: str = WIDTH, late: str = ON_TIME) -> DataFrame:
    """From flagged details, or flagged rows of ``trade_orders``."""
    amounts = {name: F.col(name) if name in flagged.columns else c for name, c in _trade_amounts().items()}
    return summarize(
        flagged, width, [], *_sums("order_unique_user_count", "order_new_user_count"), *(F.sum(c).cast(_MONEY).alias(name) for name, c in amounts.items()), late=late,
    )


def user_spu_order(rows: DataFrame, spu: DataFrame, trademark: DataFrame, chain: DataFrame, width: str = WIDTH, late: str = ON_TIME) -> DataFrame:
    """From details with their sku's dimensions; names join the small aggregate."""
    sums = _order_sums(rows, width, ["user_id", "spu_id", "trademark_id", "category3_id"], "order_count", late)
    return name_of(name_of(sums, spu, "spu_id", "spu_name"), trademark, "trademark_id", "trademark_name").join(chain, "category3_id")


def province_order(rows: DataFrame, province: DataFrame, width: str = WIDTH, late: str = ON_TIME) -> DataFrame:
    return name_of(_order_sums(rows, width, ["province_id"], "order_count", late), province, "province_id", "province_name")


def refund(rows: DataFrame, trademark: DataFrame, chain: DataFrame, width: str = WIDTH) -> DataFrame:
    sums = _order_sums(rows, width, ["user_id", "trademark_id", "category3_id"], "refund_count", ON_TIME, amount=False)
    return name_of(sums, trademark, "trademark_id", "trademark_name").join(chain, "category3_id")
