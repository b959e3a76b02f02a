"""The generated tables re-shaped into the two feeds and the dimensions, so that every job has data that grows with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import DETAIL, ORDER
from ..operators.keyed import latest
from ..schemas import LOG

#: The code dictionary (fixed values of the feeds).
CODES = ["1101", "1102", "1103", "1201", "1202", "1203", "1204", "1301", "1302", "1303", "1304", "1305", "1306", "1307", "1501", "1502", "2401", "2402", "2403", "2404"]
#: Source table, sink table, columns and key of three dimensions.
ROUTES = [("part", "dim_sku_info", "id,tm_id", "id"), ("nation", "dim_base_province", "id,name", None), ("region", "dim_base_region", "id", "id")]
#: The shop's database, and another whose tables have the same names: jobs must not mix them.
DATABASE, OTHER = "shop", "branch"
#: Tie-breaks of details with equal ids and times.
DETAIL_TIES = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
#: Rows of a table that a task is to join and put in order, so that its memory does not grow with the table.
ROWS_A_TASK = 250_000
#: Parts up to which Spark is left to broadcast them if it likes.
BROADCAST_PARTS = 2_000_000
#: All columns of the changes of orders, details, activities, coupons and refunds, as the jobs know them.
RECORD = list(dict.fromkeys([
    *DETAIL, *ORDER, "order_detail_id", "activity_id", "activity_rule_id", "coupon_id", "coupon_use_id", "refund_type", "refund_num", "refund_amount", "refund_reason_type",
    "refund_reason_txt", "refund_status", "payment_type", "callback_time",
]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A generated table; its times without zone become timestamps in the session's zone."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.select(*(F.col(c).cast("timestamp").alias(c) if kind.startswith("timestamp") else F.col(c) for c, kind in rows.dtypes))


def partitions(spark: SparkSession, sf_dir: str, name: str) -> int | None:
    """Partitions for steps as long as this table, whose rows Parquet's footers tell; None where the session's number is enough."""
    needed = -(-table(spark, sf_dir, name).count() // ROWS_A_TASK)
    return needed if needed > _session_partitions(spark) else None


def sku_partitions(spark: SparkSession, sf_dir: str) -> int | None:
    """Partitions for joins of order lines with more parts than can be broadcast."""
    return partitions(spark, sf_dir, "lineitem") if table(spark, sf_dir, "part").count() > BROADCAST_PARTS else None


def _session_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dictionary(spark: SparkSession) -> DataFrame:
    return _values(spark, ["dic_code", "dic_name"], [(c, f"name_{c}") for c in CODES])


def config(spark: SparkSession) -> DataFrame:
    return _values(spark, ["source_table", "sink_table", "sink_columns", "sink_pk", "sink_extend"], [(*r, "") for r in ROUTES])


def _values(spark: SparkSession, names: list[str], rows: list[tuple[str | None, ...]]) -> DataFrame:
    """A table of settings as a literal, whose size the optimizer knows."""
    listed = ", ".join("(" + ", ".join("CAST(NULL AS STRING)" if v is None else f"'{v}'" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t({', '.join(names)})")


def _text(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def _change(rows: DataFrame, name: str, kind: str, time: Column, data: dict[str, Column], old: dict[str, Column] | None = None, database: str = DATABASE, record: list[str] | None = None) -> DataFrame:
    """A change; its ``data`` is a map, or the ``record``'s columns beside the others, of which Spark computes only those that a job takes."""

    def as_map(columns: dict[str, Column] | None) -> Column:
        pairs = [x for k, v in (columns or {}).items() for x in (F.lit(k), v.cast("string"))]
        return F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")

    values = [as_map(data).alias("data")] if record is None else [data.get(c, F.lit(None)).cast("string").alias(c) for c in record]
    return rows.select(
        F.lit(database).alias("database"), F.lit(name).alias("table"), F.lit(kind).alias("type"), F.unix_seconds(time).cast("string").alias("ts"), *values, as_map(old).alias("old"),
    ).alias("data")


def elsewhere(spark: SparkSession, sf_dir: str, *names: str, record: list[str] | None = None) -> DataFrame:
    """Changes of tables of these names in the other database, with keys and codes that would pass for the shop's."""
    rows = table(spark, sf_dir, "nation")
    key, day = F.col("n_nationkey") + 1, F.to_timestamp(F.lit("2024-01-01"))
    keys = {c: key for c in ("id", "order_id", "order_detail_id", "user_id", "sku_id", "province_id", "coupon_id", "activity_id", "spu_id", "tm_id")}
    codes = {"source_type": "2401", "payment_type": "1101", "refund_type": "1501", "refund_reason_type": "1301", "appraise": "1201", "payment_status": "1602", "refund_status": "0705", "sku_num": "9", "refund_num": "9"}
    data = keys | {k: F.lit(v) for k, v in codes.items()} | {c: _text(day) for c in ("create_time", "callback_time", "operate_time", "get_time", "using_time", "used_time")}
    before = {c: F.lit("1401" if c == "coupon_status" else "1") for c in ("order_status", "refund_status", "sku_num", "coupon_status")}
    out = None
    for name in names:
        for kind, status in (("insert", "1001"), ("update", "1003"), ("update", "1005"), ("update", "1006")):
            part = _change(rows, name, kind, day, data | {"order_status": F.lit(status), "coupon_status": F.lit("1402")}, before, OTHER, record)
            out = part if out is None else out.union(part)
    return out


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    seconds = F.make_dt_interval(secs=F.col("o_orderkey") % 86400)
    return rows.withColumn("made", F.col("o_orderdate") + seconds)


def order_info(spark: SparkSession, sf_dir: str, record: list[str] | None = None) -> DataFrame:
    rows = orders(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    later = F.col("made") + F.expr("INTERVAL 300 SECONDS")

    def data(status: Column) -> dict[str, Column]:
        return {
            "id": F.col("o_orderkey"), "user_id": F.col("o_custkey"), "province_id": F.col("c_nationkey"), "order_status": status,
            "create_time": _text(F.col("made")), "operate_time": _text(later), "total_amount": _money("o_totalprice"),
        }

    first = _change(rows, "order_info", "insert", F.col("made"), data(F.lit("1001")), record=record)
    status = F.when(F.col("o_orderstatus") == "F", "1003").otherwise("1005")
    second = _change(rows.where("o_orderstatus IN ('F', 'P')"), "order_info", "update", later, data(status), {"order_status": F.lit("1001")}, record=record)
    third = _change(rows.where("o_orderstatus = 'P' AND o_orderkey % 2 = 0"), "order_info", "update", later, data(F.lit("1006")), {"order_status": F.lit("1005")}, record=record)
    return first.union(second).union(third).union(elsewhere(spark, sf_dir, "order_info", record=record))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, moved once to their order's partition: ``order_id`` is the key of all that joins them or puts them in order."""
    rows = table(spark, sf_dir, "lineitem").withColumn("order_id", F.col("l_orderkey").cast("string"))
    rows = rows.repartition(partitions(spark, sf_dir, "lineitem") or _session_partitions(spark), "order_id")
    return rows.withColumn("id", F.concat_ws("-", "order_id", "l_linenumber")).withColumn("price", _money("l_extendedprice")).withColumn("discount", _money("l_discount"))


def _lines_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(_lines(spark, sf_dir), ["order_id", "l_linenumber"], ["l_shipdate", *DETAIL_TIES])


def order_detail(spark: SparkSession, sf_dir: str, record: list[str] | None = None) -> DataFrame:
    made = orders(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("order_id"), "made")
    rows = _lines(spark, sf_dir).join(made, "order_id")
    cut = F.col("price") * F.col("discount")
    data = {
        "id": F.col("id"), "order_id": F.col("order_id"), "sku_id": F.col("l_partkey"), "sku_num": F.col("l_quantity").cast("int"), "order_price": F.col("price"),
        "create_time": _text(F.col("made")), "source_type": 2401 + F.col("l_suppkey") % 4, "source_id": F.col("l_suppkey"), "split_total_amount": F.col("price") - cut,
        "split_activity_amount": F.when(F.col("l_returnflag") == "A", cut), "split_coupon_amount": F.when(F.col("l_returnflag") == "R", cut),
    }
    return _change(rows, "order_detail", "insert", F.col("l_shipdate"), data, record=record).union(elsewhere(spark, sf_dir, "order_detail", record=record))


def order_detail_extras(spark: SparkSession, sf_dir: str, record: list[str] | None = None) -> DataFrame:
    rows = _lines_once(spark, sf_dir)
    parts = []
    for flag, kind in (("A", "activity"), ("R", "coupon")):
        data = {"id": F.concat(F.lit(kind[0]), "id"), "order_id": F.col("order_id"), "order_detail_id": F.col("id"), f"{kind}_id": F.col("l_suppkey")}
        parts.append(_change(rows.where(F.col("l_returnflag") == flag), f"order_detail_{kind}", "insert", F.col("l_shipdate"), data, record=record))
    return parts[0].union(parts[1]).union(elsewhere(spark, sf_dir, "order_detail_activity", "order_detail_coupon", record=record))


def payment_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).where("o_orderstatus = 'O'")
    paid = F.col("made") + F.make_dt_interval(secs=F.when(F.col("o_orderkey") % 5 == 0, 1200).otherwise(600))
    data = {"order_id": F.col("o_orderkey"), "user_id": F.col("o_custkey"), "payment_type": 1101 + F.col("o_orderkey") % 3, "payment_status": F.lit("1602"), "callback_time": _text(paid)}
    return _change(rows, "payment_info", "update", paid, data, {"payment_status": F.lit("1601")}).union(elsewhere(spark, sf_dir, "payment_info"))


def refunds(spark: SparkSession, sf_dir: str, record: list[str] | None = None) -> DataFrame:
    made = orders(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("order_id"), "made", "o_custkey")
    rows = _lines_once(spark, sf_dir).where("l_returnflag = 'R'").join(made, "order_id")
    asked = F.col("made") + F.expr("INTERVAL 1 DAY")

    def data(status: str) -> dict[str, Column]:
        return {
            "id": F.concat(F.lit("r"), "id"), "user_id": F.col("o_custkey"), "order_id": F.col("order_id"), "sku_id": F.col("l_partkey"), "refund_type": 1501 + F.col("l_linenumber") % 2,
            "refund_num": F.col("l_quantity").cast("int"), "refund_amount": F.col("price"), "refund_reason_type": 1301 + F.col("l_linenumber") % 7, "refund_status": F.lit(status), "create_time": _text(asked),
        }

    even = rows.where("l_orderkey % 2 = 0")
    payment = {
        "id": F.concat(F.lit("p"), "id"), "order_id": F.col("order_id"), "sku_id": F.col("l_partkey"), "payment_type": 1101 + F.col("l_orderkey") % 3,
        "total_amount": F.col("price") * (1 - F.col("discount")), "callback_time": _text(asked),
    }
    return (
        _change(rows, "order_refund_info", "insert", asked, data("0701"), record=record)
        .union(_change(even, "order_refund_info", "update", asked, data("0705"), {"refund_status": F.lit("0701")}, record=record))
        .union(_change(even, "refund_payment", "update", asked, payment, {"refund_status": F.lit("0701")}, record=record))
        .union(elsewhere(spark, sf_dir, "order_refund_info", "refund_payment", record=record))
    )


def cart_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    base = {"id": F.col("event_id"), "user_id": F.col("user_id"), "sku_id": F.col("event_id") % 200, "create_time": _text(F.col("ts")), "source_type": 2401 + F.col("event_id") % 4}
    before = F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 4)
    clicks = _change(rows.where("event_type = 'click'"), "cart_info", "insert", F.col("ts"), base | {"sku_num": 1 + F.col("event_id") % 3})
    return clicks.union(_change(rows.where("event_type = 'purchase'"), "cart_info", "update", F.col("ts"), base | {"sku_num": F.col("event_id") % 6}, {"sku_num": before})).union(elsewhere(spark, sf_dir, "cart_info"))


def coupon_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    data = {"id": F.col("o_orderkey"), "coupon_id": F.col("o_orderkey") % 50, "user_id": F.col("o_custkey"), "order_id": F.col("o_orderkey")}
    time = _text(F.col("made"))
    return (
        _change(rows, "coupon_use", "insert", F.col("made"), data | {"get_time": time, "coupon_status": F.lit("1401")})
        .union(_change(rows.where("o_orderkey % 2 = 0"), "coupon_use", "update", F.col("made"), data | {"using_time": time, "coupon_status": F.lit("1402")}, {"coupon_status": F.lit("1401")}))
        .union(_change(rows.where("o_orderkey % 4 = 0"), "coupon_use", "update", F.col("made"), data | {"used_time": time, "coupon_status": F.lit("1403")}, {"coupon_status": F.lit("1402")}))
        .union(elsewhere(spark, sf_dir, "coupon_use"))
    )


def favors_and_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    data = {"id": F.col("event_id"), "user_id": F.col("user_id"), "sku_id": F.col("event_id") % 200, "create_time": _text(F.col("ts"))}
    favors = _change(rows.where("event_type = 'view'"), "favor_info", "insert", F.col("ts"), data)
    more = {"spu_id": F.col("event_id") % 50, "order_id": F.col("event_id") * 2, "appraise": 1201 + F.col("event_id") % 5}
    comments = _change(rows.where("event_type = 'purchase'"), "comment_info", "insert", F.col("ts"), data | more)
    return favors.union(comments).union(elsewhere(spark, sf_dir, "favor_info", "comment_info"))


def user_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(secs=F.col("c_custkey") * 37)
    rows = _change(table(spark, sf_dir, "customer"), "user_info", "insert", made, {"id": F.col("c_custkey"), "create_time": _text(made)})
    return rows.union(elsewhere(spark, sf_dir, "user_info"))


def dimension_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of configured and other tables: every nation in a kind of change of its own, parts inserted, some updated."""
    day = F.to_timestamp(F.lit("2024-01-01"))
    nation = table(spark, sf_dir, "nation")
    kinds = ["delete", "bootstrap-start", "bootstrap-complete", "bootstrap-insert"]
    parts = [_change(nation.where(F.col("n_nationkey") % 4 == i), "nation", k, day, {"id": F.col("n_nationkey"), "name": F.col("n_name"), "region_id": F.col("n_regionkey")}) for i, k in enumerate(kinds)]
    sku = table(spark, sf_dir, "part")
    data = {"id": F.col("p_partkey"), "tm_id": F.col("p_brand"), "category3_id": F.col("p_type")}
    parts.append(_change(sku, "part", "insert", day, data))
    later = day + F.expr("INTERVAL 1 HOUR")
    parts.append(_change(sku.where("p_partkey % 3 = 0"), "part", "update", later, {"id": F.col("p_partkey"), "tm_id": F.concat(F.col("p_brand"), F.lit("*"))}, {"tm_id": F.col("p_brand")}))
    parts.append(_change(table(spark, sf_dir, "supplier"), "supplier", "insert", day, {"id": F.col("s_suppkey")}))
    out = elsewhere(spark, sf_dir, "part", "nation")
    for part in parts:
        out = out.union(part)
    return out


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behaviour log records from events."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_part"), "p_name")
    e = table(spark, sf_dir, "events").join(part, F.col("event_id") % 200 == F.col("_part"))
    n, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    s = lambda c: c.cast("string")
    common = F.struct(
        F.concat(F.lit("ar_"), u % 7).alias("ar"), F.lit("b").alias("ba"), F.concat(F.lit("ch_"), u % 4).alias("ch"), F.when(u % 2 == 0, "1").otherwise("0").alias("is_new"), F.lit("m").alias("md"),
        F.concat(F.lit("mid_"), u).alias("mid"), F.lit("os").alias("os"), F.when(n % 10 != 0, s(u)).alias("uid"), F.concat(F.lit("v2.1."), n % 3).alias("vc"),
    )
    start = F.when(kind == "signup", F.struct(F.lit("icon").alias("entry"), (n % 1000).alias("loading_time"), (n % 7).alias("open_ad_id"), (n % 100).alias("open_ad_ms"), F.lit(0).cast("long").alias("open_ad_skip_ms")))
    name = F.create_map(*map(F.lit, ["view", "home", "click", "good_detail", "purchase", "payment", "error", "cart"]))[kind]
    searched = n % 3 == 1
    page = F.when(
        kind != "signup",
        F.struct(
            name.alias("page_id"), F.when(n % 3 == 0, None).when(searched, "search").otherwise("home").alias("last_page_id"), F.when(searched, F.col("p_name")).otherwise(s(n % 200)).alias("item"),
            F.when(searched, "keyword").otherwise("sku_id").alias("item_type"), F.lit("query").alias("source_type"), F.floor("value").cast("long").alias("during_time"),
        ),
    )
    ms = F.unix_millis("ts")
    entry = lambda i: F.struct(F.lit("query").alias("display_type"), s(n + i).alias("item"), F.lit("sku_id").alias("item_type"), i.cast("int").alias("order"), (i % 5).cast("int").alias("pos_id"))
    displays = F.when(kind == "view", F.when(n % 4 > 0, F.transform(F.sequence(F.lit(1), n % 4), entry)).otherwise(F.array().cast(LOG["displays"].dataType)))
    act = F.struct(F.lit("favor_add").alias("action_id"), s(n).alias("item"), F.lit("sku_id").alias("item_type"), ms.alias("ts"))
    actions = F.when((kind == "click") & (n % 2 == 0), F.array(act))
    err = F.when(kind == "error", F.struct((1000 + n % 100).cast("int").alias("error_code"), F.lit("failed").alias("msg")))
    columns = {"common": common, "start": start, "page": page, "displays": displays, "actions": actions, "err": err, "ts": ms}
    return e.select(*(c.cast(LOG[name].dataType).alias(name) for name, c in columns.items()))


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as JSON lines, some of them damaged."""
    rows = log(spark, sf_dir)
    return rows.select(F.when(F.col("ts") % 97 == 0, F.concat(F.lit("not json "), F.col("ts").cast("string"))).otherwise(F.to_json(F.struct("*"))).alias("value"))


def dims(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    part = table(spark, sf_dir, "part")
    types = part.select(F.col("p_type").alias("id")).distinct()
    second = types.select((F.length("id") % 3).alias("n")).distinct()
    return {
        "sku": part.select(F.col("p_partkey").cast("string").alias("id"), (F.col("p_partkey") % 50).cast("string").alias("spu_id"), F.col("p_brand").alias("tm_id"), F.col("p_type").alias("category3_id")),
        "spu": part.select((F.col("p_partkey") % 50).cast("string").alias("id")).distinct().withColumn("name", F.concat(F.lit("spu_"), "id")),
        "trademark": part.select(F.col("p_brand").alias("id")).distinct().withColumn("name", F.upper("id")),
        "category3": types.select("id", F.lower("id").alias("name"), (F.length("id") % 3).cast("string").alias("category2_id")),
        "category2": second.select(F.col("n").cast("string").alias("id"), F.concat(F.lit("second_"), "n").alias("name"), (F.col("n") % 2).cast("string").alias("category1_id")),
        "category1": second.select((F.col("n") % 2).cast("string").alias("id")).distinct().withColumn("name", F.concat(F.lit("first_"), "id")),
        "province": table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name")),
    }
