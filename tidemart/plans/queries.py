"""The registered queries of the warehouse jobs on the re-shaped generated tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.times import date_part, parse
from ..operators import changes as C
from ..operators import dims as D
from ..operators import facts, keyed, logs, windows
from ..sources import feeds, sinks
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Widths and limits for events that lie hours apart.
HOUR, DAY, BOUNCE_MS = "1 hour", "1 day", 6 * 3600 * 1000
#: What tells page views of one visitor and millisecond apart.
TIE = ["common.vc", "page.page_id", "page.item"]


def query(work: Query) -> Query:
    QUERIES[work.__name__] = work
    return work


# changes and keyed sinks


@query
def cdc_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = X.order_info(spark, d).select(F.to_json(F.struct("*")).alias("value"))
    rows = C.of_database(feeds.parse_changes(raw), X.DATABASE)
    return rows.select("table", "type", F.col("ts").cast("long").alias("ts"), C.new("id").alias("id"), C.new("order_status").alias("status"), C.old("order_status").alias("old_status"))


def _dimension_changes(spark: SparkSession, d: str) -> DataFrame:
    return C.of_database(X.dimension_changes(spark, d), X.DATABASE)


@query
def cdc_keep_types(spark: SparkSession, d: str) -> DataFrame:
    return C.keep_types(_dimension_changes(spark, d)).select("table", "type", C.new("id").alias("id"))


@query
def dic_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = X.table(spark, d, "events").select("event_id", (1101 + F.col("event_id") % 5).cast("string").alias("code"))
    return facts.with_name(rows, X.dictionary(spark), "code", "name")


@query
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = C.of_database(X.order_info(spark, d), X.DATABASE).select(C.new("id").alias("id"), C.new("order_status").alias("status"), F.col("ts").cast("long").alias("ts"))
    return sinks.upsert(None, rows, ["id"], ["ts", "status"])


@query
def dim_filter_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = C.route(_dimension_changes(spark, d), X.config(spark))
    return rows.select("sink_table", "type", F.array_join(F.array_sort(F.map_keys("data")), ",").alias("columns"), F.col("data")["id"].alias("id"))


@query
def dim_route(spark: SparkSession, d: str) -> DataFrame:
    rows = C.route(_dimension_changes(spark, d), X.config(spark))
    return rows.select("sink_table", "type", F.col("ts").cast("long").alias("ts"), *(F.col("data")[c].alias(c) for c in ("id", "tm_id", "name")))


@query
def dim_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = C.route(_dimension_changes(spark, d), X.config(spark))
    rows = rows.select("sink_table", F.col("data")[F.col("sink_pk")].alias("pk"), F.col("ts").cast("long").alias("ts"), "type", *(F.col("data")[c].alias(c) for c in ("tm_id", "name")))
    return sinks.partial_upsert(rows, ["sink_table", "pk"], ["tm_id", "name"], ["ts", "type"])


@query
def dws_replace_latest(spark: SparkSession, d: str) -> DataFrame:
    events = X.table(spark, d, "events").withColumn("rt", F.col("ts"))
    early, late = (windows.summarize(rows, HOUR, ["event_type"], F.count(F.lit(1)).alias("n")).withColumn("ts", F.lit(v).cast("long")) for v, rows in ((1, events.where("event_id % 2 = 0")), (2, events)))
    return sinks.replace_latest(early.unionByName(late), ["event_type"])


# behaviour log


@query
def log_parse(spark: SparkSession, d: str) -> DataFrame:
    good, _ = feeds.parse_log(X.raw_log(spark, d))
    return good.select(F.col("common.mid").alias("mid"), "ts", F.col("page.page_id").alias("page_id"), F.col("start.entry").alias("entry"), F.coalesce(F.size("displays"), F.lit(-1)).alias("n_displays"), F.col("err.error_code").alias("error_code"))


@query
def log_dirty(spark: SparkSession, d: str) -> DataFrame:
    return feeds.parse_log(X.raw_log(spark, d))[1]


@query
def log_fix_is_new(spark: SparkSession, d: str) -> DataFrame:
    return keyed.fix_is_new(X.log(spark, d)).select(F.col("common.mid").alias("mid"), "ts", F.col("common.is_new").alias("is_new"))


@query
def log_error(spark: SparkSession, d: str) -> DataFrame:
    return logs.errors(X.log(spark, d)).select(F.col("common.mid").alias("mid"), "ts", F.col("page.page_id").alias("page_id"), F.col("err.error_code").alias("error_code"))


@query
def log_start(spark: SparkSession, d: str) -> DataFrame:
    return logs.starts(X.log(spark, d)).select(F.col("common.mid").alias("mid"), "ts", "start.entry", "start.loading_time", "start.open_ad_id", "start.open_ad_ms")


@query
def log_display(spark: SparkSession, d: str) -> DataFrame:
    return logs.displays(X.log(spark, d)).select(F.col("common.mid").alias("mid"), "ts", "page.page_id", "display.item", F.col("display.order").alias("place"), "display.pos_id")


@query
def log_action(spark: SparkSession, d: str) -> DataFrame:
    return logs.actions(X.log(spark, d)).select(F.col("common.mid").alias("mid"), "page.page_id", "action.action_id", "action.item", F.col("action.ts").alias("action_ts"))


@query
def log_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """All outputs of the log in one pass, counted by kind and visitor."""
    rows = logs.fan_out(feeds.parse_lines(X.raw_log(spark, d)))
    return rows.groupBy("kind", F.col("common.mid").alias("mid")).agg(F.count(F.lit(1)).alias("n"), F.sum("ts").alias("sum_ts"))


@query
def log_fan_out_items(spark: SparkSession, d: str) -> DataFrame:
    """Displays and actions out of the same pass."""
    rows = logs.fan_out(feeds.parse_lines(X.raw_log(spark, d))).where(F.col("kind").isin("display", "action"))
    return rows.select("kind", "page.page_id", F.coalesce("display.item", "action.item").alias("item"), F.col("display.order").alias("place"), F.coalesce("ts", "action.ts").alias("ts"))


def _flat_pages(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"common.{c}").alias(c) for c in ("mid", "uid", "vc", "ch", "ar", "is_new")), *(F.col(f"page.{c}").alias(c) for c in ("page_id", "last_page_id", "item", "item_type", "during_time")), "ts")


@query
def log_page(spark: SparkSession, d: str) -> DataFrame:
    return _flat_pages(logs.pages(X.log(spark, d)))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return logs.pages(keyed.fix_is_new(X.log(spark, d)))


@query
def dwd_unique_visitor(spark: SparkSession, d: str) -> DataFrame:
    return _flat_pages(logs.unique_visitors(_pages(spark, d), TIE))


@query
def dwd_user_jump(spark: SparkSession, d: str) -> DataFrame:
    return _flat_pages(keyed.bounces(_pages(spark, d), BOUNCE_MS, TIE))


# facts


def _wide(spark: SparkSession, d: str, extras: bool = True) -> DataFrame:
    feed = X.order_detail(spark, d, X.RECORD).union(X.order_info(spark, d, X.RECORD))
    feed = feed.union(X.order_detail_extras(spark, d, X.RECORD)) if extras else feed
    return facts.order_pre_process(feed.alias("data"), X.dictionary(spark), database=X.DATABASE, extras=extras, by_order=True)


def _numbers(rows: DataFrame) -> DataFrame:
    """Text columns of money and quantity as numbers."""
    kinds = {"order_price": "double", "split_total_amount": "double", "split_activity_amount": "double", "split_coupon_amount": "double", "sku_num": "long", "refund_amount": "double", "total_amount": "double", "refund_num": "long"}
    return rows.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in rows.columns))


_SHOWN = ["id", "order_id", "user_id", "sku_id", "sku_num", "order_price", "province_id", "activity_id", "coupon_id", "source_type_id", "source_type_name", "split_total_amount", "split_activity_amount", "split_coupon_amount"]


@query
def dwd_cart_add(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(facts.cart_add(X.cart_info(spark, d), X.dictionary(spark), X.DATABASE).select("id", "user_id", "sku_id", "sku_num", "create_time", "source_type_id", "source_type_name"))


@query
def dwd_order_pre_process(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(_wide(spark, d).select(*_SHOWN, "order_status", "type", F.col("old")["order_status"].alias("old_status"), "create_time", "operate_time", "order_detail_activity_id", "order_detail_coupon_id"))


@query
def dwd_order_detail(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(facts.order_detail(_wide(spark, d)).select(*_SHOWN, "create_time"))


@query
def dwd_cancel_detail(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(facts.cancel_detail(_wide(spark, d)).select(*_SHOWN, "cancel_time"))


def _paid(spark: SparkSession, d: str, **options: object) -> DataFrame:
    details = facts.order_detail(_wide(spark, d, extras=False))
    return facts.pay_detail_suc(X.payment_info(spark, d), details, X.dictionary(spark), database=X.DATABASE, **options)


_PAID = ["p_order_id", "order_detail_id", "user_id", "sku_id", "payment_type_id", "payment_type_name", "callback_time", "split_total_amount"]


@query
def dwd_pay_detail_suc(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(_paid(spark, d, retention_s=905).select(*_PAID))


@query
def pay_detail_inner(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(_paid(spark, d, how="inner").select(*_PAID))


def _refunds(spark: SparkSession, d: str) -> DataFrame:
    return facts.order_refund(X.refunds(spark, d, X.RECORD).union(X.order_info(spark, d, X.RECORD)).alias("data"), X.dictionary(spark), database=X.DATABASE)


@query
def dwd_order_refund(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(_refunds(spark, d).select("id", "user_id", "order_id", "sku_id", "province_id", "refund_type_id", "refund_type_name", "refund_reason_type_id", "refund_reason_type_name", "refund_num", "refund_amount", "create_time"))


@query
def dwd_refund_pay_suc(spark: SparkSession, d: str) -> DataFrame:
    rows = facts.refund_pay_suc(X.refunds(spark, d, X.RECORD).union(X.order_info(spark, d, X.RECORD)).alias("data"), X.dictionary(spark), database=X.DATABASE)
    return _numbers(rows.select("id", "user_id", "order_id", "sku_id", "province_id", "payment_type_id", "payment_type_name", "refund_num", "total_amount", "callback_time"))


@query
def dwd_coupon_get(spark: SparkSession, d: str) -> DataFrame:
    return facts.coupon_get(X.coupon_use(spark, d), X.DATABASE).select("id", "coupon_id", "user_id", "get_time")


@query
def dwd_coupon_order(spark: SparkSession, d: str) -> DataFrame:
    return facts.coupon_order(X.coupon_use(spark, d), X.DATABASE).select("id", "coupon_id", "user_id", "order_id", "using_time")


@query
def dwd_coupon_pay(spark: SparkSession, d: str) -> DataFrame:
    return facts.coupon_pay(X.coupon_use(spark, d), X.DATABASE).select("id", "coupon_id", "user_id", "order_id", "used_time")


@query
def dwd_favor_add(spark: SparkSession, d: str) -> DataFrame:
    return facts.favor_add(X.favors_and_comments(spark, d), X.DATABASE).select("id", "user_id", "sku_id", "create_time")


@query
def dwd_comment(spark: SparkSession, d: str) -> DataFrame:
    return facts.comment(X.favors_and_comments(spark, d), X.dictionary(spark), X.DATABASE).select("id", "user_id", "sku_id", "spu_id", "order_id", "appraise_type_id", "appraise_type_name", "create_time")


@query
def dwd_user_register(spark: SparkSession, d: str) -> DataFrame:
    return facts.user_register(X.user_info(spark, d), X.DATABASE).select("id", "create_time", F.col("ts").cast("long").alias("ts"))


# keyed work and dimensions


def _by_time() -> list[str | Column]:
    """Change time, with all that tells changes of one time apart."""
    return ["row_op_ts", *(F.col(c).cast(kind) for c, kind in (("sku_id", "long"), ("source_id", "long"), ("sku_num", "long"), ("order_price", "decimal(18,2)")))]


def _details(spark: SparkSession, d: str, last: bool) -> DataFrame:
    """Order details once per id: the first or the last by change time. The jobs on them use neither activities nor coupons.

    A detail's id is of one order, so repeats lie where their order's rows are.
    """
    rows = facts.order_detail(_wide(spark, d, extras=False))
    rows = (keyed.latest if last else keyed.first)(rows, ["order_id", "id"], _by_time())
    return rows.withColumn("rt", parse(F.col("create_time")))


@query
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(_details(spark, d, False).select("id", "sku_id", "sku_num", "order_price", "split_total_amount"))


@query
def dedup_latest(spark: SparkSession, d: str) -> DataFrame:
    return _numbers(_details(spark, d, True).select("id", "sku_id", "sku_num", "order_price", "split_total_amount"))


@query
def dim_enrich_sku(spark: SparkSession, d: str) -> DataFrame:
    rows = C.of_database(X.order_detail(spark, d, X.RECORD).alias("data"), X.DATABASE).select(C.new("id").alias("id"), C.new("sku_id").alias("sku_id"))
    return D.enrich_sku(rows, X.dims(spark, d)["sku"], X.sku_partitions(spark, d))


def _chain(dims: dict[str, DataFrame]) -> DataFrame:
    return D.category_chain(dims["category3"], dims["category2"], dims["category1"])


@query
def dim_category_chain(spark: SparkSession, d: str) -> DataFrame:
    return _chain(X.dims(spark, d))


@query
def keyword_tokens(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "part").select("p_partkey", F.explode(tokens(F.concat(F.col("p_name"), F.lit(" 手机壳 A1")))).alias("keyword"))


# summaries: the rows with their event time ``rt``, and what sums them up


def _searches(spark: SparkSession, d: str) -> DataFrame:
    return windows.searches(logs.pages(X.log(spark, d)))


def _traffic(spark: SparkSession, d: str) -> DataFrame:
    return windows.traffic_flags(_pages(spark, d), BOUNCE_MS, TIE)


def _first_views(spark: SparkSession, d: str) -> DataFrame:
    rows = logs.pages(X.log(spark, d)).where(F.col("page.page_id").isin("home", "good_detail"))
    rows = rows.select(F.col("common.mid").alias("mid"), F.col("page.page_id").alias("page_id"), F.timestamp_millis("ts").alias("rt"))
    return keyed.first_per_day(rows, ["mid", "page_id"], "rt", [])


def _logins(spark: SparkSession, d: str) -> DataFrame:
    return keyed.daily_logins(logs.pages(X.log(spark, d)))


def _registrations(spark: SparkSession, d: str) -> DataFrame:
    return facts.user_register(X.user_info(spark, d), X.DATABASE).withColumn("rt", parse(F.col("create_time")))


def _cart_firsts(spark: SparkSession, d: str) -> DataFrame:
    rows = facts.cart_add(X.cart_info(spark, d), X.dictionary(spark), X.DATABASE).withColumn("rt", parse(F.coalesce("operate_time", "create_time")))
    return keyed.first_per_day(rows, ["user_id"], "rt", ["id"])


def _payments(spark: SparkSession, d: str) -> DataFrame:
    rows = keyed.latest(_paid(spark, d).where("order_detail_id IS NOT NULL"), ["order_id", "order_detail_id"], _by_time())
    rows = rows.withColumn("rt", parse(F.col("callback_time"))).withColumn("day", date_part(F.col("callback_time")))
    return keyed.unique_and_new(rows, "user_id", "rt", ["order_detail_id"], "payment_suc_unique_user_count", "payment_new_user_count", X.partitions(spark, d, "lineitem"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.trade_orders(_details(spark, d, False))
    return keyed.unique_and_new(rows, "user_id", "rt", ["id"], "order_unique_user_count", "order_new_user_count", X.partitions(spark, d, "orders"))


def _sku_orders(spark: SparkSession, d: str) -> DataFrame:
    """First details with their sku's dimensions; many are brought to their group at once, since there are about as many groups as details."""
    rows = D.enrich_sku(_details(spark, d, False), X.dims(spark, d)["sku"], X.sku_partitions(spark, d))
    n = X.partitions(spark, d, "lineitem")
    return rows.repartition(n, "user_id", "spu_id", "trademark_id", "category3_id") if n else rows


def _last_orders(spark: SparkSession, d: str) -> DataFrame:
    return _details(spark, d, True)


def _sku_refunds(spark: SparkSession, d: str) -> DataFrame:
    return D.enrich_sku(_refunds(spark, d).withColumn("rt", parse(F.col("create_time"))), X.dims(spark, d)["sku"])


#: Name of a summary -> its rows, and the summary of them by the dimensions of the tables; a stream of the rows takes the same function.
SUMMARIES: dict[str, tuple[Query, Callable[[DataFrame, Callable[[], dict[str, DataFrame]]], DataFrame]]] = {
    "keyword": (_searches, lambda rows, dims: windows.keyword(rows, DAY)),
    "traffic": (_traffic, lambda rows, dims: windows.traffic(rows, HOUR)),
    "page_view": (_first_views, lambda rows, dims: windows.page_view(rows, HOUR)),
    "user_login": (_logins, lambda rows, dims: windows.user_login(rows, HOUR)),
    "user_register": (_registrations, lambda rows, dims: windows.user_register(rows, HOUR)),
    "cart_add": (_cart_firsts, lambda rows, dims: windows.cart_add(rows, HOUR)),
    "payment": (_payments, lambda rows, dims: windows.payment(rows, DAY)),
    "trade_order": (_orders, lambda rows, dims: windows.trade_order(rows, DAY)),
    "user_spu_order": (_sku_orders, lambda rows, dims: windows.user_spu_order(rows, (x := dims())["spu"], x["trademark"], _chain(x), DAY)),
    "province_order": (_last_orders, lambda rows, dims: windows.province_order(rows, dims()["province"], DAY)),
    "refund": (_sku_refunds, lambda rows, dims: windows.refund(rows, (x := dims())["trademark"], _chain(x), DAY)),
}


def _amounts(rows: DataFrame) -> DataFrame:
    """Amounts as doubles for comparison; they were summed as decimals."""
    return rows.select(*(F.col(c).cast("double").alias(c) if c.endswith("_amount") else F.col(c) for c in rows.columns))


def _summary(name: str) -> Query:
    rows, summary = SUMMARIES[name]
    return lambda spark, d: _amounts(summary(rows(spark, d), lambda: X.dims(spark, d)))


QUERIES |= {f"dws_{name}_window": _summary(name) for name in SUMMARIES}
