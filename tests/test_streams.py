"""A stream over several files ends in what the batch gives."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemart import schemas
from tidemart.operators import dims as D
from tidemart.operators import facts, keyed, logs, windows
from tidemart.plans import fixtures as X
from tidemart.plans.queries import SUMMARIES
from tidemart.schemas import CHANGE
from tidemart.sources import sinks
from tidemart.streaming import jobs, states

DATA = "/root/testdata/sf0.001"
FAR = 4_000_000_000_000


def flat_pages(spark):
    rows = logs.pages(X.log(spark, DATA))
    return rows.select(F.col("common.mid").alias("mid"), F.col("common.uid").alias("uid"), F.col("page.page_id").alias("page_id"), F.col("page.last_page_id").alias("last_page_id"), F.col("ts").alias("ms"))


def as_stream(spark, df, tmp_path, order, closing=None, parts=3):
    """``df`` in files by time, one a micro-batch, and a closing row far in the future."""
    path = f"{tmp_path}/in"
    rows = df.toPandas().sort_values(order, kind="stable").reset_index(drop=True)
    step = -(-len(rows) // parts)
    pieces = [spark.createDataFrame(rows.iloc[i : i + step], df.schema) for i in range(0, len(rows), step)]
    if closing:
        pieces.append(spark.createDataFrame([closing], df.schema))
    for piece in pieces:
        piece.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def ended(spark, df, tmp_path, name="out"):
    out = f"{tmp_path}/{name}"
    jobs.run_to_end(df, out, f"{tmp_path}/{name}-checkpoint")
    return spark.read.schema(df.schema).parquet(out)


def same(got, expected):
    columns = sorted(expected.columns)
    key = lambda df: sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    assert key(got) == key(expected)


def test_registrations(spark, tmp_path):
    rows = facts.user_register(X.user_info(spark, DATA)).select("id", "create_time")
    stream = as_stream(spark, rows, tmp_path, "create_time", ("x", "2090-01-01 00:00:00")).withColumn("rt", F.to_timestamp("create_time"))
    summary = lambda df: windows.user_register(df, "10 minutes")
    got = ended(spark, jobs.windowed(stream, "user_register", summary), tmp_path)
    same(got.where("stt < '2090'"), summary(rows.withColumn("rt", F.to_timestamp("create_time"))))


def jittered(spark, df, tmp_path, time, spread, closing, parts=4, seed=3):
    """``df`` in files, one a micro-batch, whose rows come up to ``spread`` (in units of ``time``) late and in no order; then a closing row."""
    rng = np.random.default_rng(seed)
    number = lambda v: v.timestamp() if hasattr(v, "timestamp") else v
    rows = [tuple(r) for _, _, r in sorted((number(r[time]) + rng.uniform(0, spread), i, r) for i, r in enumerate(df.collect()))]
    step = -(-len(rows) // parts)
    pieces = [spark.createDataFrame(rows[i : i + step], df.schema) for i in range(0, len(rows), step)]
    for piece in [*pieces, spark.createDataFrame([closing], df.schema)]:
        piece.coalesce(1).write.mode("append").parquet(f"{tmp_path}/jittered")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/jittered")


def nested(rows):
    return rows.select(F.struct("mid").alias("common"), F.struct("last_page_id").alias("page"), F.col("ms").alias("ts"))


def test_bounces(spark, tmp_path):
    rows = flat_pages(spark).select("mid", "last_page_id", "ms")
    day = 86_400_000
    stream = jobs.with_time(jittered(spark, rows, tmp_path, "ms", day, ("zz", "home", FAR))).drop("ms")
    limit = 6 * 3600 * 1000
    got = ended(spark, states.bounces(stream, "rt", "2 days", limit_ms=limit), tmp_path).select("mid", "ms")
    same(got, keyed.bounces(nested(rows), limit).select("common.mid", F.col("ts").alias("ms")))


def test_a_start_that_comes_late_hides_no_bounce(spark, tmp_path):
    """Starts at 100 s and 150 s, then in the next batch a view at 90 s: the reference orders by event time."""
    row = "mid string, last_page_id string, ms long"
    for part in ([("a", None, 100_000), ("a", None, 150_000)], [("a", "home", 90_000), ("a", "home", 153_000)], [("zz", "home", FAR)]):
        spark.createDataFrame(part, row).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(row).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = ended(spark, states.bounces(jobs.with_time(stream).drop("ms"), "rt", "100 seconds"), tmp_path)
    assert [r.ms for r in got.collect()] == [100_000]


DAY_MS = 86_400_000


def test_unique_visitors(spark, tmp_path):
    rows = flat_pages(spark).where("last_page_id IS NULL").select("mid", "ms", F.monotonically_increasing_id().alias("n"))
    stream = jobs.with_time(jittered(spark, rows, tmp_path, "ms", 3 * DAY_MS, ("zz", FAR, 0))).drop("ms")
    batch = keyed.first_per_day(jobs.with_time(rows), ["mid"], "rt", ["n"])
    got = ended(spark, states.first_per_day(stream, ["mid"], "rt", ["n"], "4 days"), tmp_path)
    same(got.where("mid <> 'zz'").select("mid", "ms", "rt", "n"), batch.select("mid", "ms", "rt", "n"))


def test_a_row_of_an_earlier_day_that_comes_a_batch_late_is_first_of_its_day(spark, tmp_path):
    for part in ([("a", 2 * DAY_MS + 5)], [("a", DAY_MS + 7), ("a", DAY_MS + 9)], [("zz", FAR)]):
        spark.createDataFrame(part, "mid string, ms long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.with_time(spark.readStream.schema("mid string, ms long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")).drop("ms")
    got = ended(spark, states.first_per_day(stream, ["mid"], "rt", watermark="2 days"), tmp_path)
    assert sorted(r.ms for r in got.collect()) == [DAY_MS + 7, 2 * DAY_MS + 5]


def test_states_of_a_day_end_with_it(spark, tmp_path):
    """Days come to their end by event time, their state rows go, and the run ends."""
    for d in range(1, 5):
        spark.createDataFrame([(m, d * DAY_MS + 1000 * i) for i, m in enumerate("abc")], "mid string, ms long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.with_time(spark.readStream.schema("mid string, ms long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")).drop("ms")
    days = lambda: sorted(r.value.day for r in spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/out-checkpoint").collect())
    got = ended(spark, states.first_per_day(stream, ["mid"], "rt"), tmp_path)
    assert got.count() == 10 and days() == ["1970-01-05"]  # of the last day the row at the watermark
    spark.createDataFrame([("d", 4 * DAY_MS + 9000)], "mid string, ms long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = ended(spark, states.first_per_day(stream, ["mid"], "rt"), tmp_path)
    assert got.count() == 12 and days() == ["1970-01-05"] * 3
    spark.createDataFrame([("e", 7 * DAY_MS)], "mid string, ms long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ended(spark, states.first_per_day(stream, ["mid"], "rt"), tmp_path)
    assert days() == []


def test_new_flags(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", 10), ("a", "1", 20), ("a", "1", 90_000_000), ("b", "0", 5), ("b", "1", 90_000_000), ("b", "1", 200_000_000), ("c", "1", 100_000_000), ("c", "0", 180_000_000), ("c", "1", 180_000_000), ("c", None, 300_000_000), (None, "1", 7)], "mid string, is_new string, ms long")
    log = rows.select(F.struct("mid", "is_new").alias("common"), F.col("ms").alias("ts"))
    stream = jobs.with_time(jittered(spark, rows, tmp_path, "ms", 3 * DAY_MS, ("zz", "1", FAR))).drop("ms")
    for backfill in (False, True):
        got = ended(spark, states.fix_is_new(stream, "mid", "rt", backfill, "4 days"), tmp_path, f"out{backfill}").where("mid <> 'zz'").select("mid", "ms", "is_new")
        same(got, keyed.fix_is_new(log.where("common.mid IS NOT NULL"), backfill).select("common.mid", F.col("ts").alias("ms"), "common.is_new"))


@pytest.mark.parametrize("name", sorted(SUMMARIES))
def test_summaries(spark, tmp_path, name):
    """Every summary as a stream of unordered micro-batches gives what the batch gives."""
    made, summary = SUMMARIES[name]
    rows, dims = made(spark, DATA).cache(), lambda: X.dims(spark, DATA)
    closing = tuple(datetime.datetime(2090, 1, 1) if c == "rt" else "1" if k == "string" else 0 if k in ("bigint", "int") else None for c, k in rows.dtypes)
    stream = jittered(spark, rows, tmp_path, "rt", 86_400, closing, parts=2)
    got = ended(spark, jobs.windowed(stream, name, lambda df: summary(df, dims), delay="3 days"), tmp_path)
    same(got.where("stt < '2090'"), summary(rows, dims))
    assert sinks.versioned(got, schemas.SUMMARIES[name], F.lit(1)).columns == ["stt", "edt", *schemas.SUMMARIES[name], "ts", "dt"]


def repeated(rows, spread=3):
    """Rows of an id several times over, as a join that comes to its result piece by piece gives them; the same time, other change times."""
    return rows.withColumn("seq", F.explode(F.sequence(F.lit(1), F.lit(spread) - F.pmod(F.xxhash64("rt"), F.lit(2)).cast("int"))))


def order_rows(spark):
    made = [(str(i), str(i % 7) if i % 5 else None, str(i % 4), str(i % 3), str(i % 6), "10.5", str(i % 3 + 1), "9.25", "1.0", None if i % 2 else "0.5", datetime.datetime(2024, 1, 1 + i % 4, i % 24, i % 60, 7, 1000 * i)) for i in range(120)]
    names = "id user_id order_id province_id sku_id order_price sku_num split_total_amount split_activity_amount split_coupon_amount".split()
    return spark.createDataFrame(made, ", ".join(f"{n} string" for n in names) + ", rt timestamp")


def dimension_rows(spark):
    dim = lambda kind, n, *more: spark.createDataFrame([(str(i), f"{kind} {i}", *(str(i % k) for k in (2,) * len(more))) for i in range(n)], ", ".join(f"{c} string" for c in ("id", "name", *more)))
    sku = spark.createDataFrame([(str(i), str(i % 3), str(i % 2), str(i % 2)) for i in range(5)], "id string, spu_id string, tm_id string, category3_id string")
    chain = spark.createDataFrame([(str(i), f"c3 {i}", "0", "c2", "0", "c1") for i in range(2)], "category3_id string, category3_name string, category2_id string, category2_name string, category1_id string, category1_name string")
    return sku, dim("spu", 3), dim("tm", 2), dim("province", 3), chain


CHAINS = ["page_view", "user_login", "cart_add", "payment", "trade_order", "user_spu_order", "province_order", "refund"]


@pytest.mark.parametrize("name", CHAINS)
def test_chains_from_facts_to_windows_in_one_query(spark, tmp_path, name):
    """Order, repeats, first days and windows in one query with one checkpoint, on unordered micro-batches: what the batch gives."""
    sku, spu, trademark, province, chain = dimension_rows(spark)
    base = order_rows(spark)
    far = datetime.datetime(2090, 1, 1)
    wide, delay = "1 hour", "5 days"
    if name in ("page_view", "user_login", "cart_add"):
        rows = base.select(F.col("user_id").alias("mid"), F.col("user_id").alias("uid"), "user_id", F.when(F.col("sku_id") < "3", "home").otherwise("good_detail").alias("page_id"), "rt", F.col("id").cast("int").alias("n"))
    elif name == "refund":
        rows = base
    else:
        rows = repeated(base.withColumn("order_detail_id", F.col("id"))).withColumn("split_total_amount", F.concat("seq", F.lit(".25")))
    tie, by = ["n"], ["seq"]
    firsts = lambda key: keyed.first_per_day(rows, key, "rt", tie)
    nested = lambda df: df.select(F.struct("uid").alias("common"), F.struct(F.lit(None).cast("string").alias("last_page_id")).alias("page"), F.unix_millis("rt").alias("ts"))
    flagged = lambda df, id_, u, n: keyed.unique_and_new(df, "user_id", "rt", [id_], u, n)
    batch, stream = {
        "page_view": (lambda: windows.page_view(firsts(["mid", "page_id"]), wide), lambda s: jobs.page_views(s, wide, delay, tie)),
        "user_login": (lambda: windows.user_login(keyed.daily_logins(nested(rows)), wide), lambda s: jobs.user_logins(s, wide, delay, tie)),
        "cart_add": (lambda: windows.cart_add(firsts(["user_id"]), wide), lambda s: jobs.cart_adds(s, wide, delay, tie)),
        "payment": (lambda: windows.payment(flagged(keyed.latest(rows, ["order_detail_id"], by), "order_detail_id", "payment_suc_unique_user_count", "payment_new_user_count"), wide), lambda s: jobs.payments(s, by, wide, delay)),
        "trade_order": (lambda: windows.trade_order(flagged(keyed.first(rows, ["id"], by), "id", "order_unique_user_count", "order_new_user_count"), wide), lambda s: jobs.trade_orders(s, by, wide, delay)),
        "user_spu_order": (lambda: windows.user_spu_order(D.enrich_sku(keyed.first(rows, ["id"], by), sku), spu, trademark, chain, wide), lambda s: jobs.user_spu_orders(s, by, sku, spu, trademark, chain, wide, delay)),
        "province_order": (lambda: windows.province_order(keyed.latest(rows, ["id"], by), province, wide), lambda s: jobs.province_orders(s, by, province, wide, delay)),
        "refund": (lambda: windows.refund(D.enrich_sku(rows, sku), trademark, chain, wide), lambda s: jobs.refunds(s, sku, trademark, chain, wide, delay)),
    }[name]
    closing = tuple(far if k == "timestamp" else "zz" if k == "string" else 1 for _, k in rows.dtypes)
    got = ended(spark, stream(jittered(spark, rows, tmp_path, "rt", 2 * 86_400, closing)), tmp_path)
    expected = batch()
    same(got.where("stt < '2090'"), expected)
    assert expected.count() > 10


def test_traffic_of_three_streams(spark, tmp_path):
    """Page views, unique visitors and bounces land apart; their union waits for the bounces."""
    page = logs.pages(X.log(spark, DATA)).cache()
    limit = 6 * 3600 * 1000
    parts = {"page": page, "visitors": logs.unique_visitors(page), "jumps": keyed.bounces(page, limit)}
    closing = page.limit(1).withColumn("ts", F.lit(FAR))
    for name, rows in parts.items():
        for piece in (rows.where("ts % 2 = 0"), rows.where("ts % 2 = 1"), closing, closing.withColumn("ts", F.lit(FAR + 60_000_000))):
            piece.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    streams = [spark.readStream.schema(page.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}") for name in parts]
    got = ended(spark, jobs.traffic(*streams, width="1 hour", delay="60 days"), tmp_path)
    same(got.where("stt < '2090'"), windows.traffic(windows.traffic_flags(page, limit), "1 hour"))


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    row = "id string, ms long"
    for part in ([("a", 1_000)], [("b", 100_000)], [("c", 101_000)], [("late", 2_000), ("d", 99_500)], [("z", FAR)]):
        spark.createDataFrame(part, row).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.with_time(spark.readStream.schema(row).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    got = ended(spark, jobs.windowed(stream, "user_register", windows.user_register), tmp_path)
    assert sorted((r.stt[-8:], r.register_ct) for r in got.where("stt < '2090'").collect()) == [("00:00:00", 1), ("00:01:30", 1), ("00:01:40", 2)]


def test_logins_and_flags(spark, tmp_path):
    """In no order, and with rows that have no user."""
    rows = flat_pages(spark).where("last_page_id IS NULL").select("uid", "ms", F.monotonically_increasing_id().alias("n"))
    stream = jobs.with_time(jittered(spark, rows, tmp_path, "ms", 3 * DAY_MS, ("zz", FAR, 0))).drop("ms")
    nested = rows.select(F.struct("uid").alias("common"), F.struct(F.lit(None).cast("string").alias("last_page_id")).alias("page"), F.col("ms").alias("ts"))
    batch = keyed.daily_logins(nested, away_days=2).select("uid", F.unix_millis("rt").alias("ms"), "uu_ct", "back_ct")
    same(ended(spark, states.daily_logins(stream, "uid", "rt", 2, watermark="4 days"), tmp_path).where("uid <> 'zz'").select("uid", "ms", "uu_ct", "back_ct"), batch)
    flags = keyed.unique_and_new(jobs.with_time(rows), "uid", "rt", ["n"], "u", "v").select("uid", "ms", "u", "v")
    same(ended(spark, states.user_flags(stream, "uid", "rt", "u", "v", ["n"], "4 days"), tmp_path, "flags").where("NOT uid <=> 'zz'").select("uid", "ms", "u", "v"), flags)


def test_first_and_latest_per_id(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1000, 1, "x"), ("a", 2000, 1, "y"), ("a", 2000, 2, "z"), ("b", 1500, 1, "w"), ("b", 1400, 5, "v"), ("c", 9000, 1, "u"), ("c", 7000, None, "t")], "id string, ms long, seq int, v string")
    stream = jobs.with_time(jittered(spark, rows, tmp_path, "ms", 4000, ("zz", FAR, 1, "end"))).drop("ms")
    for name, by_stream, by_batch in (("latest", states.latest, keyed.latest), ("first", states.first, keyed.first)):
        got = ended(spark, by_stream(stream, ["id"], "rt", ["seq"], "10 seconds"), tmp_path, name).where("id <> 'zz'")
        same(got.select("id", "v", "ms"), by_batch(rows, ["id"], ["ms", "seq"]).select("id", "v", "ms"))
        assert got.where("unix_millis(rt) <> ms + 5000").count() == 0


def test_repeats_are_near_in_time(spark, tmp_path):
    """Rows of an id far apart are not repeats, in whatever order they come."""
    rows = spark.createDataFrame([("a", 1000, "x"), ("a", 4000, "y"), ("a", 60_000, "z"), ("a", 61_000, "w"), ("b", 60_500, "v")], "id string, ms long, v string")
    stream = jobs.with_time(jittered(spark, rows, tmp_path, "ms", 100_000, ("zz", FAR, "end"))).drop("ms")
    got = ended(spark, states.latest(stream, ["id"], "rt", [], "10 minutes"), tmp_path).where("id <> 'zz'")
    assert sorted((r.id, r.v, r.ms) for r in got.collect()) == [("a", "w", 61_000), ("a", "y", 4000), ("b", "v", 60_500)]


def test_dedup_within_watermark(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1000), ("a", 1500), ("b", 2000)], "id string, ms long")
    stream = jobs.with_time(as_stream(spark, rows, tmp_path, "ms"))
    assert ended(spark, states.first_in_watermark(stream, ["id"], "rt"), tmp_path).count() == 2


CODES = [("2401", "search"), ("1101", "cash"), ("1301", "r"), ("1501", "t")]


def feed_stream(spark, tmp_path, rows):
    """Changes (table, kind, seconds, data, old) as a stream, then closing changes of every table far in the future, twice."""
    text = lambda x: x and {k: str(v) for k, v in x.items()}
    rows = [("shop", t, k, str(ts), text(d), text(o)) for t, k, ts, d, o in rows]
    far = {"id": 99, "order_id": 99, "order_detail_id": 99, "source_type": 1, "payment_status": 1602, "payment_type": 1, "refund_type": 1, "refund_reason_type": 1, "sku_id": 99, "callback_time": "2096-10-02 07:06:40", "create_time": "2096-10-02 07:06:40"}
    tables = ("order_detail", "order_info", "order_detail_activity", "order_detail_coupon", "payment_info", "order_refund_info", "refund_payment")
    statuses = ((1005, 1001, "0705"), (1006, 1005, "0705"))
    end = [("shop", t, k, "4000000000", text(far | {"order_status": s, "refund_status": r}), text({"order_status": b, "refund_status": 1})) for t in tables for k in ("insert", "update") for s, b, r in statuses]
    for part in (rows, end, end):
        spark.createDataFrame(part, CHANGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), spark.createDataFrame(CODES, "dic_code string, dic_name string"), spark.createDataFrame(rows, CHANGE)


def test_wide_order_as_a_stream_of_joins(spark, tmp_path):
    rows = [("order_detail", "insert", 100, {"id": 1, "order_id": 1, "source_type": 2401}, None), ("order_info", "insert", 101, {"id": 1, "user_id": 7}, None), ("order_detail_coupon", "insert", 101, {"id": 5, "order_detail_id": 1, "coupon_id": 3}, None), ("order_detail", "insert", 102, {"id": 2, "order_id": 2, "source_type": 2401}, None)]
    stream, codes, _ = feed_stream(spark, tmp_path, rows)
    wide = facts.order_pre_process(stream, codes, retention="10 SECONDS").select("id", "user_id", "coupon_id", "source_type_name")
    got = sorted(tuple(r) for r in ended(spark, wide, tmp_path).collect())
    assert got == [("1", "7", "3", "search"), ("2", None, None, "search")]


def test_payments_as_a_stream(spark, tmp_path):
    paid = lambda order, at, kind=1101: ("payment_info", "update", 100, {"order_id": order, "payment_type": kind, "payment_status": 1602, "callback_time": f"1970-01-02 {at}"}, None)
    stream, codes, batch = feed_stream(spark, tmp_path, [paid(1, "00:10:00"), paid(2, "01:00:00"), paid(3, "00:10:00"), paid(1, "00:10:00", 9)])
    row = "id string, order_id string, create_time string"
    details = [("d1", "1", "1970-01-02 00:00:00"), ("d2", "1", "1970-01-02 00:01:00"), ("d3", "2", "1970-01-02 00:00:00")]
    for part in (details, [("z", "99", "2096-10-02 07:06:40")], [("z", "99", "2096-10-02 07:06:40")]):
        spark.createDataFrame(part, row).coalesce(1).write.mode("append").parquet(f"{tmp_path}/details")
    landed = spark.readStream.schema(row).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/details")
    for how, wanted in (("left", [("1", "d1"), ("1", "d2"), ("2", None), ("3", None)]), ("inner", [("1", "d1"), ("1", "d2")])):
        show = lambda df: sorted((r.p_order_id, r.order_detail_id) for r in df.where("p_order_id <> '99'").collect())
        assert show(facts.pay_detail_suc(batch, spark.createDataFrame(details, row), codes, how, 905)) == wanted
        assert show(ended(spark, facts.pay_detail_suc(stream, landed, codes, how, 905).select("p_order_id", "order_detail_id"), tmp_path, how)) == wanted


def test_refunds_as_streams(spark, tmp_path):
    asked = lambda i, order, ts: ("order_refund_info", "insert", ts, {"id": i, "order_id": order, "sku_id": 1, "refund_type": 1501, "refund_reason_type": 1301}, None)
    turned = lambda order, ts, status, before: ("order_info", "update", ts, {"id": order, "province_id": 8, "user_id": 4, "order_status": status}, {"order_status": before})
    rows = [asked("a", 1, 100), turned(1, 103, 1005, 1001), asked("b", 2, 100), turned(2, 500, 1005, 1001), asked("c", 3, 100)]
    rows += [("order_refund_info", "update", 110, {"order_id": o, "sku_id": 1, "refund_num": 2, "refund_status": "0705"}, {"refund_status": "0701"}) for o in (1, 2)]
    rows += [turned(1, 111, 1006, 1005), turned(2, 700, 1006, 1005), *(("refund_payment", "update", 112, {"id": f"p{o}", "order_id": o, "sku_id": 1, "payment_type": 1101}, None) for o in (1, 2))]
    stream, codes, batch = feed_stream(spark, tmp_path, rows)
    for name, job, wanted in (
        ("refund", lambda df: facts.order_refund(df, codes, "10 SECONDS").select("id", "province_id"), [("a", "8"), ("b", None), ("c", None)]),
        ("paid", lambda df: facts.refund_pay_suc(df, codes, retention="10 SECONDS").select("id", "refund_num", "user_id"), [("p1", "2", "4")]),
    ):
        show = lambda df: sorted(tuple(r) for r in df.where("id <> '99'").collect())
        assert show(job(batch)) == wanted and show(ended(spark, job(stream), tmp_path, name)) == wanted
