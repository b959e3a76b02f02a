"""Detail facts from change records, one function a fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import parse
from .changes import cart_increments, change_seconds, changed, changes_of, moved, new

# Status codes of the feeds (fixed values).
CANCELLED, REFUNDING, REFUNDED = "1003", "1005", "1006"
PAID, REFUND_PAID = "1602", "0705"
COUPON_UNUSED, COUPON_USING = "1401", "1402"

DETAIL = ["id", "order_id", "sku_id", "sku_name", "order_price", "sku_num", "create_time", "source_type", "source_id", "split_total_amount", "split_activity_amount", "split_coupon_amount"]
ORDER = [
    "consignee", "consignee_tel", "total_amount", "order_status", "user_id", "payment_way", "delivery_address", "order_comment", "out_trade_no", "trade_body",
    "operate_time", "expire_time", "process_status", "tracking_no", "parent_order_id", "province_id", "activity_reduce_amount", "coupon_reduce_amount",
    "original_total_amount", "feight_fee", "feight_fee_reduce", "refundable_time",
]
_DETAIL_FACT = [
    "id", "order_id", "user_id", "sku_id", "sku_name", "sku_num", "order_price", "province_id", "activity_id", "activity_rule_id", "coupon_id",
    "create_time", "source_id", "source_type_id", "source_type_name", "split_activity_amount", "split_coupon_amount", "split_total_amount", "row_op_ts",
]


def with_name(rows: DataFrame, dictionary: DataFrame, code: str, name: str) -> DataFrame:
    """The rows whose ``code`` the dictionary has, with its ``name``. The dictionary is small; Spark broadcasts it by its size."""
    return rows.join(dictionary.select(F.col("dic_code").alias(code), F.col("dic_name").alias(name)), code)


def change_time() -> Column:
    """Source time of a change as a timestamp, which a rerun repeats; null if it is no number."""
    return F.timestamp_seconds(change_seconds())


#: How late rows of the two sides of a stream's join may come.
WATERMARK = "2 seconds"


def _late(rows: DataFrame, time: str) -> DataFrame:
    return rows.withWatermark(time, WATERMARK) if rows.isStreaming else rows


def _near(side: str, time: str, retention: str) -> Column:
    """Whether two times lie within the interval; a null time is near none."""
    reach = F.expr(f"INTERVAL {retention}")
    return (F.col(side) >= F.col(time) - reach) & (F.col(side) <= F.col(time) + reach)


def cart_add(changes: DataFrame, dictionary: DataFrame, database: str | None = None) -> DataFrame:
    rows = with_name(cart_increments(changes, database), dictionary, "source_type", "source_type_name")
    return rows.withColumnRenamed("source_type", "source_type_id")


def _attach(details: DataFrame, sides: list[DataFrame]) -> DataFrame:
    """Left joins of ``sides`` by ``order_id`` and ``id``, as lists collected inside the partitions of the orders.

    A join by both keys would move all rows; a window keeps them where their order's rows are. Rows without a key match nothing.
    """
    names = [[c for c in side.columns if c not in ("order_id", "id")] for side in sides]
    rows = details.withColumn("_detail", F.lit(True))
    for i, side in enumerate(sides):
        part = side.where("order_id IS NOT NULL AND id IS NOT NULL").select("order_id", "id", F.struct(*names[i]).alias(f"_side{i}"))
        rows = rows.unionByName(part, allowMissingColumns=True)
    same = Window.partitionBy("order_id", "id")
    rows = rows.withColumns({f"_side{i}": F.collect_list(f"_side{i}").over(same) for i in range(len(sides))}).where("_detail")
    for i in range(len(sides)):
        rows = rows.select("*", F.inline_outer(f"_side{i}")).drop(f"_side{i}")
    return rows.drop("_detail")


def order_pre_process(
    changes: DataFrame, dictionary: DataFrame, retention: str | None = None, database: str | None = None, extras: bool = True, by_order: bool = False
) -> DataFrame:
    """Order details with each change of their order, their activity, coupon and source name.

    ``retention`` (an interval) also bounds the times between a detail and what joins it, as streams need it. Without
    ``extras`` activities and coupons are not joined and their columns are null, for jobs that use neither. ``by_order`` says that
    activities and coupons carry their detail's ``order_id``, too: a batch then moves all rows once, to their order.
    """
    details = changes_of(changes, "order_detail", ("insert",), DETAIL, also=[change_time().alias("row_op_ts")], database=database)
    orders = changes_of(changes, "order_info", ("insert", "update"), ["id", *ORDER], also=["type", "old", change_time().alias("o_ts")], database=database)
    sides = [(orders.withColumnRenamed("id", "o_id"), "order_id", "o_id", "o_ts")]
    inside = []
    if by_order and (retention or details.isStreaming):
        raise ValueError("by_order is for batches without retention")
    for kind, columns in (("activity", ["activity_id", "activity_rule_id"]), ("coupon", ["coupon_id", "coupon_use_id"])):
        key, time = f"{kind[0]}_id", f"{kind[0]}_ts"
        if extras and by_order:
            side = changes_of(changes, f"order_detail_{kind}", ("insert",), ["id", "order_id", "order_detail_id", *columns], database=database)
            inside.append(side.withColumnsRenamed({"id": f"order_detail_{kind}_id", "order_detail_id": "id"}))
        elif extras:
            side = changes_of(changes, f"order_detail_{kind}", ("insert",), ["id", "order_detail_id", *columns], also=[change_time().alias(time)], database=database)
            sides.append((side.withColumnsRenamed({"id": f"order_detail_{kind}_id", "order_detail_id": key}), "id", key, time))
    details = _attach(details, inside) if inside else _late(details, "row_op_ts")
    for side, left, right, time in sides:
        on = F.col(left) == F.col(right)
        details = details.join(_late(side, time), on & _near(time, "row_op_ts", retention) if retention else on, "left").drop(right, time)
    if not extras:
        details = details.withColumns({c: F.lit(None).cast("string") for c in ("order_detail_activity_id", "activity_id", "activity_rule_id", "order_detail_coupon_id", "coupon_id", "coupon_use_id")})
    return with_name(details.withColumnRenamed("source_type", "source_type_id"), dictionary, "source_type_id", "source_type_name")


def order_detail(wide: DataFrame) -> DataFrame:
    return wide.where(F.col("type") == "insert").select(*_DETAIL_FACT)


def cancel_detail(wide: DataFrame) -> DataFrame:
    rows = wide.where((F.col("type") == "update") & F.col("old")["order_status"].isNotNull() & (F.col("order_status") == CANCELLED))
    return rows.select(*("operate_time" if c == "create_time" else c for c in _DETAIL_FACT)).withColumnRenamed("operate_time", "cancel_time")


def pay_detail_suc(changes: DataFrame, details: DataFrame, dictionary: DataFrame, how: str = "left", retention_s: int | None = None, database: str | None = None) -> DataFrame:
    """Successful payments with the details of their order; a payment without any stays with nulls unless ``how`` is inner.

    ``retention_s`` bounds the seconds between a detail and its payment; streams need it, and forget what is older. A
    payment or detail whose time cannot be read is then near nothing; a stream drops a payment without a readable time.
    """
    paid = changes_of(changes, "payment_info", ("update",), ["order_id", "payment_type", "callback_time"], new("payment_status") == PAID, database=database)
    paid = paid.withColumnsRenamed({"order_id": "p_order_id", "payment_type": "payment_type_id"}).withColumn("_paid", parse(F.col("callback_time")))
    # payments without an order match nothing; keys of their own keep them out of one task
    paid = paid.withColumn("_key", F.coalesce("p_order_id", F.concat(F.lit("\0"), F.xxhash64("payment_type_id", "callback_time").cast("string"))))
    details = details.withColumn("_made", parse(F.col("create_time")))
    if paid.isStreaming:
        if retention_s is None:
            raise ValueError("a stream needs retention_s")
        paid, details = _late(paid.where("_paid IS NOT NULL"), "_paid"), _late(details, "_made")
    on = F.col("_key") == F.col("order_id")
    rows = paid.join(details, on & _near("_paid", "_made", f"{retention_s} SECONDS") if retention_s is not None else on, how)
    return with_name(rows.drop("_key", "_paid", "_made").withColumnRenamed("id", "order_detail_id"), dictionary, "payment_type_id", "payment_type_name")


def order_refund(changes: DataFrame, dictionary: DataFrame, retention: str | None = None, database: str | None = None) -> DataFrame:
    """Refunds asked for, with the province of their order if it has turned to refunding.

    ``retention`` (an interval) bounds the times between a refund and its order's change, as streams need it.
    """
    columns = ["id", "user_id", "order_id", "sku_id", "refund_type", "refund_num", "refund_amount", "refund_reason_type", "refund_reason_txt", "refund_status", "create_time"]
    refunds = changes_of(changes, "order_refund_info", ("insert",), columns, also=[change_time().alias("row_op_ts")], database=database)
    turned = (new("order_status") == REFUNDING) & changed("order_status")
    orders = changes_of(changes, "order_info", ("update",), ["id", "province_id"], turned, [change_time().alias("o_ts")], database)
    on = F.col("order_id") == F.col("o_id")
    on = on & _near("o_ts", "row_op_ts", retention) if retention else on
    rows = _late(refunds, "row_op_ts").join(_late(orders.withColumnRenamed("id", "o_id"), "o_ts"), on, "left").drop("o_id", "o_ts")
    rows = rows.withColumnsRenamed({"refund_type": "refund_type_id", "refund_reason_type": "refund_reason_type_id"})
    return with_name(with_name(rows, dictionary, "refund_reason_type_id", "refund_reason_type_name"), dictionary, "refund_type_id", "refund_type_name")


def refund_pay_suc(
    changes: DataFrame, dictionary: DataFrame, by_sku: bool = True, payment_done: Column | None = None, retention: str | None = None, database: str | None = None
) -> DataFrame:
    """Paid refunds. ``by_sku`` joins a payment with the refund of its own sku, else with all refunds of its order.

    ``retention`` (an interval) bounds the times between a payment and what joins it, and so what streams remember.
    """
    refunded = (new("refund_status") == REFUND_PAID) & changed("refund_status")
    done = changes_of(changes, "order_refund_info", ("update",), ["order_id", "sku_id", "refund_num"], refunded, [change_time().alias("d_ts")], database)
    done = done.withColumnsRenamed({"order_id": "d_order_id", "sku_id": "d_sku_id"})
    turned = (new("order_status") == REFUNDED) & changed("order_status")
    orders = changes_of(changes, "order_info", ("update",), ["id", "user_id", "province_id"], turned, [change_time().alias("o_ts")], database).withColumnRenamed("id", "o_id")
    columns = ["id", "order_id", "sku_id", "payment_type", "total_amount", "callback_time"]
    rows = _late(changes_of(changes, "refund_payment", ("insert", "update"), columns, payment_done, [change_time().alias("row_op_ts")], database), "row_op_ts")
    same = F.col("order_id") == F.col("d_order_id")
    for side, time, on in ((done, "d_ts", same & (F.col("sku_id") == F.col("d_sku_id")) if by_sku else same), (orders, "o_ts", F.col("order_id") == F.col("o_id"))):
        rows = rows.join(_late(side, time), on & _near(time, "row_op_ts", retention) if retention else on)
    rows = rows.drop("d_order_id", "d_sku_id", "d_ts", "o_id", "o_ts").withColumnRenamed("payment_type", "payment_type_id")
    return with_name(rows, dictionary, "payment_type_id", "payment_type_name")


def coupon_get(changes: DataFrame, database: str | None = None) -> DataFrame:
    return changes_of(changes, "coupon_use", ("insert",), ["id", "coupon_id", "user_id", "get_time"], also=["ts"], database=database)


def coupon_order(changes: DataFrame, database: str | None = None) -> DataFrame:
    columns = ["id", "coupon_id", "user_id", "order_id", "using_time"]
    return changes_of(changes, "coupon_use", ("update",), columns, moved("coupon_status", COUPON_UNUSED, COUPON_USING), ["ts"], database)


def coupon_pay(changes: DataFrame, database: str | None = None) -> DataFrame:
    return changes_of(changes, "coupon_use", ("update",), ["id", "coupon_id", "user_id", "order_id", "used_time"], new("used_time").isNotNull(), ["ts"], database)


def favor_add(changes: DataFrame, database: str | None = None) -> DataFrame:
    return changes_of(changes, "favor_info", ("insert",), ["id", "user_id", "sku_id", "create_time"], also=["ts"], database=database)


def comment(changes: DataFrame, dictionary: DataFrame, database: str | None = None) -> DataFrame:
    columns = ["id", "user_id", "sku_id", "spu_id", "order_id", "appraise", "create_time"]
    rows = changes_of(changes, "comment_info", ("insert",), columns, also=["ts"], database=database)
    return with_name(rows.withColumnRenamed("appraise", "appraise_type_id"), dictionary, "appraise_type_id", "appraise_type_name")


def user_register(changes: DataFrame, database: str | None = None) -> DataFrame:
    return changes_of(changes, "user_info", ("insert",), ["id", "create_time"], also=["ts"], database=database)
