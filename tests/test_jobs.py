"""Hand-computed cases of the warehouse jobs."""

from __future__ import annotations

import json
import random
import time

from pyspark.sql import functions as F

from tidemart.functions import text
from tidemart.functions.text import explode_words, tokens
from tidemart.functions.times import date_part, parse, to_millis, to_time_text
from tidemart.operators import changes as C
from tidemart.operators import facts, keyed, logs, windows
from tidemart.schemas import CHANGE, LOG
from tidemart.sources import feeds, sinks
from tidemart.streaming import jobs


def page(spark, rows):
    """(mid, seconds, last page[, is_new[, uid]]) as page views."""
    made = []
    for mid, s, last, *more in rows:
        is_new, uid = [*more, "1", None][:2] if more else ("1", None)
        made.append({"common": {"mid": mid, "is_new": is_new, "uid": uid, "vc": "v", "ch": "c", "ar": "a"}, "page": {"page_id": "home", "last_page_id": last, "during_time": 5}, "ts": int(s * 1000)})
    return logs.pages(spark.createDataFrame([json.loads(json.dumps(x)) for x in made], LOG))


def change(spark, rows):
    return spark.createDataFrame([("shop", t, kind, "1700000000", data, old) for t, kind, data, old in rows], CHANGE)


def test_bounces(spark):
    rows = [("b", 407, "x"), ("a", 416, None), ("a", 430, None), ("a", 433, None), ("a", 438, None)]
    assert sorted(r.ts // 1000 for r in keyed.bounces(page(spark, rows)).collect()) == [416, 430, 433, 438]
    assert keyed.bounces(page(spark, [("a", 0, None), ("a", 5, "home")])).count() == 0
    assert keyed.bounces(page(spark, [("a", 0, None), ("a", 10, "home")])).count() == 1


def test_unique_visitors_once_a_day(spark):
    rows = [("a", 10, None), ("a", 20, None), ("a", 5, "home"), ("a", 86400 + 1, None), ("b", 7, None)]
    assert sorted((r.common.mid, r.ts // 1000) for r in logs.unique_visitors(page(spark, rows)).collect()) == [("a", 10), ("a", 86401), ("b", 7)]


def test_new_flag_repaired_after_first_day(spark):
    rows = [("a", 10, None, "1", None), ("a", 86400, None, "1", None), ("b", 5, None, "0", None), ("b", 86400, None, "1", None)]
    got = lambda **o: sorted((r.common.mid, r.ts // 1000, r.common.is_new) for r in keyed.fix_is_new(page(spark, rows), **o).collect())
    assert got() == [("a", 10, "1"), ("a", 86400, "0"), ("b", 5, "0"), ("b", 86400, "1")]
    assert got(backfill=True)[-1] == ("b", 86400, "0")


def test_logins_after_a_week(spark):
    day = 86400
    rows = [("m", d * day + 5, None, "1", u) for u, d in (("7", 1), ("7", 8), ("8", 1), ("8", 9))] + [("m", 3, None, "1", None), ("m", day + 9, "login", "1", "7")]
    got = sorted((r.uid, r.rt.day, r.uu_ct, r.back_ct) for r in keyed.daily_logins(page(spark, rows)).collect())
    assert got == [("7", 2, 1, 0), ("7", 9, 1, 0), ("8", 2, 1, 0), ("8", 10, 1, 1)]


def test_latest_takes_later_arrival_on_ties(spark):
    rows = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 1, "y"), ("a", 2, 2, "z"), ("b", None, 1, "w")], "id string, t int, seq int, v string")
    assert sorted((r.id, r.v) for r in keyed.latest(rows, ["id"], ["t", "seq"]).collect()) == [("a", "z"), ("b", "w")]
    assert sorted((r.id, r.v) for r in keyed.first(rows, ["id"], ["t", "seq"]).collect()) == [("a", "x"), ("b", "w")]


def test_cart_increments(spark):
    rows = [("cart_info", "insert", {"id": "1", "sku_num": "2"}, None), ("cart_info", "update", {"id": "2", "sku_num": "5"}, {"sku_num": "2"}), ("cart_info", "update", {"id": "3", "sku_num": "4"}, {"sku_num": "5"}), ("cart_info", "update", {"id": "4", "sku_num": "4"}, {"x": "5"})]
    assert sorted((r.id, r.sku_num) for r in C.cart_increments(change(spark, rows)).collect()) == [("1", "2"), ("2", "3")]


def test_changed_from_null(spark):
    rows = change(spark, [("t", "update", {"a": "1"}, {"a": None}), ("t", "update", {"a": "1"}, {"a": "0"})])
    assert rows.where(C.changed("a")).count() == 1 and rows.where(C.changed("a", from_null=True)).count() == 2


def test_coupon_steps(spark):
    feed = change(spark, [("coupon_use", "insert", {"id": "1"}, None), ("coupon_use", "update", {"id": "1", "coupon_status": "1402"}, {"coupon_status": "1401"}), ("coupon_use", "update", {"id": "1", "used_time": "t"}, {"coupon_status": "1402"}), ("coupon_use", "delete", {"id": "1"}, None)])
    assert [facts.coupon_get(feed).count(), facts.coupon_order(feed).count(), facts.coupon_pay(feed).count()] == [1, 1, 1]


def test_unmatched_payment_stays_and_unknown_code_goes(spark):
    feed = change(spark, [("payment_info", "update", {"order_id": o, "payment_type": t, "payment_status": "1602", "callback_time": "2024-01-01 00:00:00"}, None) for o, t in (("1", "1101"), ("2", "9"))])
    details = spark.createDataFrame([], "id string, order_id string, create_time string")
    codes = spark.createDataFrame([("1101", "cash")], "dic_code string, dic_name string")
    rows = facts.pay_detail_suc(feed, details, codes).collect()
    assert [(r.p_order_id, r.order_detail_id, r.payment_type_name) for r in rows] == [("1", None, "cash")]
    assert facts.pay_detail_suc(feed, details, codes, how="inner").count() == 0


def test_refund_payment_joins_by_sku(spark):
    feed = change(spark, [x for s in "ab" for x in (("order_refund_info", "update", {"order_id": "1", "sku_id": s, "refund_num": "1", "refund_status": "0705"}, {"refund_status": "0"}), ("refund_payment", "update", {"id": s, "order_id": "1", "sku_id": s, "payment_type": "1101"}, None))] + [("order_info", "update", {"id": "1", "user_id": "u", "order_status": "1006"}, {"order_status": "1005"})])
    codes = spark.createDataFrame([("1101", "cash")], "dic_code string, dic_name string")
    assert facts.refund_pay_suc(feed, codes).count() == 2 and facts.refund_pay_suc(feed, codes, by_sku=False).count() == 4


def test_bad_values_end_no_job(spark):
    codes = spark.createDataFrame([("1101", "cash"), ("2401", "s"), ("1301", "r"), ("1501", "t")], "dic_code string, dic_name string")
    feed = [("order_detail", "insert", "x", {"id": "1", "order_id": "1", "source_type": "2401", "create_time": "never"}, None), ("order_info", "insert", None, {"id": "1"}, None)]
    feed += [("payment_info", "update", "1", {"order_id": "1", "payment_type": "1101", "payment_status": "1602", "callback_time": "soon"}, None), ("payment_info", "update", "1", {"payment_type": "1101", "payment_status": "1602"}, None)]
    feed += [("order_refund_info", "insert", "1e", {"order_id": "1", "refund_type": "1501", "refund_reason_type": "1301"}, None), ("order_refund_info", "update", "?", {"order_id": "1", "refund_status": "0705"}, {"refund_status": "0"})]
    feed += [("refund_payment", "update", "", {"order_id": "1", "payment_type": "1101"}, None), (None, "insert", "5", {}, None)]
    rows = spark.createDataFrame([("shop", t, k, ts, d, o) for t, k, ts, d, o in feed], CHANGE)
    wide = facts.order_pre_process(rows, codes)
    assert [r.row_op_ts for r in wide.collect()] == [None] and facts.order_pre_process(rows, codes, retention="1 DAY").count() == 1
    paid = lambda **o: sorted((r.p_order_id, r.order_detail_id) for r in facts.pay_detail_suc(rows.where("data['order_id'] IS NOT NULL OR `table` <> 'payment_info'"), facts.order_detail(wide), codes, **o).collect())
    assert paid() == [("1", "1")] and paid(retention_s=905) == [("1", None)] and paid(retention_s=905, how="inner") == []
    assert facts.pay_detail_suc(rows, facts.order_detail(wide), codes).where("p_order_id IS NULL AND order_detail_id IS NULL").count() == 1
    assert facts.order_refund(rows, codes).count() == 1 and facts.refund_pay_suc(rows, codes).count() == 0
    assert C.set_aside(rows).count() == 6
    bad = spark.createDataFrame([("1", "a", "b", "x", "y", "z"), ("2", "1.5", "2", "3", "4", "5")], "order_id string, order_price string, sku_num string, split_activity_amount string, split_coupon_amount string, split_total_amount string")
    bad = bad.withColumns({"rt": F.to_timestamp(F.lit("2024-01-01")), "order_unique_user_count": F.lit(1), "order_new_user_count": F.lit(0), "province_id": F.lit("1")})
    got = windows.trade_order(bad).first()
    assert (float(got.order_origin_total_amount), float(got.order_activity_reduce_amount), float(got.order_coupon_reduce_amount)) == (3.0, 3.0, 4.0)
    province = spark.createDataFrame([("1", "p")], "id string, name string")
    assert [(r.order_count, float(r.order_amount)) for r in windows.province_order(bad, province).collect()] == [(2, 5.0)]


def test_changes_of_another_database_stay_out(spark):
    rows = spark.createDataFrame([(b, "user_info", "insert", "1", {"id": b}, None) for b in ("shop", "branch", None)], CHANGE)
    assert [r.id for r in facts.user_register(rows, "shop").collect()] == ["shop"] and facts.user_register(rows).count() == 3


def test_configuration_changes_with_its_feed(spark):
    line = lambda t, columns, pk=None: (t, f"dim_{t}", columns, pk, None)
    kind = "source_table string, sink_table string, sink_columns string, sink_pk string, sink_extend string"
    feed = [(None, line("a", "id,x"), "r", 1), (None, line("b", "k,y", "k"), "c", 2), (line("a", "id,x"), line("a", "id,x,z"), "u", 3), (line("b", "k,y", "k"), None, "d", 4), (None, line("c", "id"), "c", 5), (line("c", "id"), None, "d", 6), (None, line("c", "id,w"), "c", 7)]
    config = C.current_config(spark.createDataFrame(feed, f"before struct<{kind.replace(' ', ':')}>, after struct<{kind.replace(' ', ':')}>, op string, ts_ms long".replace(",:", ",")))
    assert sorted((r.source_table, r.sink_columns) for r in config.collect()) == [("a", "id,x,z"), ("c", "id,w")]
    routed = C.route(change(spark, [("a", "insert", {"id": "1", "x": "2", "secret": "3"}, None), ("b", "insert", {"k": "1"}, None)]), config).collect()
    assert [(r.sink_table, r.sink_pk, r.data) for r in routed] == [("dim_a", "id", {"id": "1", "x": "2"})]


def test_users_first_rows(spark):
    rows = spark.createDataFrame([("u", "2024-01-01 05:00:00", "b"), ("u", "2024-01-01 05:00:00", "a"), ("u", "2024-01-02 01:00:00", "c"), (None, "2024-01-01 00:00:00", "d"), ("v", None, "e")], "user string, t string, id string").withColumn("rt", F.to_timestamp("t"))
    got = {r.id: (r.one, r.first) for r in keyed.unique_and_new(rows, "user", "rt", ["id"], "one", "first").collect()}
    assert got == {"a": (1, 1), "b": (0, 0), "c": (1, 0), "d": (0, 0), "e": (0, 0)}


def test_bounces_across_hours(spark):
    hour = 3600
    rows = [("a", 10, None), ("a", hour - 1, None), ("a", hour + 2, "home"), ("a", 5 * hour, None), ("a", 9 * hour, "home"), ("b", hour - 1, None), ("b", hour, None), (None, 5, None)]
    assert sorted((r.common.mid, r.ts // 1000) for r in keyed.bounces(page(spark, rows)).collect()) == [("a", 10), ("a", 5 * hour), ("b", hour - 1), ("b", hour)]


def test_parse_log_splits_dirty_lines(spark):
    good = json.dumps({"common": {"mid": "a"}, "page": {"page_id": "home"}, "ts": 1})
    raw = spark.createDataFrame([(good,), ("not json",), ("{}",), (None,)], "value string")
    rows, bad = feeds.parse_log(raw)
    assert rows.count() == 1 and sorted(str(r.value) for r in bad.collect()) == ["None", "not json", "{}"]


def test_actions_without_own_time(spark):
    row = {"common": {"mid": "a"}, "page": {"page_id": "p"}, "actions": [{"action_id": "x", "ts": 9}], "displays": [], "ts": 5}
    log = spark.createDataFrame([row], LOG)
    assert "ts" not in logs.actions(log).columns and logs.actions(log, with_ts=True).first().ts == 5
    assert logs.displays(log).count() == 0 and logs.pages(log).count() == 1


def test_times(spark):
    row = spark.range(1).select(
        (parse(F.lit("2023-01-03T11:10:55.060Z")) > parse(F.lit("2023-01-03T11:10:55.05Z"))).alias("later"), (parse(F.lit("2023-01-03T11:10:55Z")) < parse(F.lit("2023-01-03T11:10:55.1Z"))).alias("whole"),
        to_time_text(F.lit(0).cast("long")).alias("zero"), to_millis(F.lit("1970-01-02")).alias("day"), date_part(F.lit("2024-01-01 10:00:00")).alias("part"), parse(F.lit("never")).alias("none"),
    ).first()
    assert row.asDict() == {"later": True, "whole": True, "zero": "1970-01-01 00:00:00", "day": 86_400_000, "part": "2024-01-01", "none": None}


def test_tokens(spark):
    row = spark.range(1).select(tokens(F.lit("Red手机壳 x9")).alias("t"), tokens(F.lit(" !? ")).alias("e")).first()
    assert row.t == ["red", "手机", "机壳", "x9"] and row.e == []
    words = spark.createDataFrame([("苹果手机新款",), (None,)], "s string")
    assert [r.keyword for r in explode_words(words, "s", lexicon=["苹果手机"]).collect()] == ["苹果手机", "新款"]


def test_partial_upsert_and_replace_latest(spark):
    rows = spark.createDataFrame([("k", 1, "a", None), ("k", 2, None, "b"), ("k", 3, "c", None)], "id string, t int, x string, y string")
    assert [tuple(r) for r in sinks.partial_upsert(rows, ["id"], ["x", "y"], ["t"]).collect()] == [("k", "c", "b")]
    early, late = (sinks.column_versions(rows.where(w), ["id"], ["x", "y"], ["t"]) for w in ("t <> 2", "t <= 2"))
    for a, b in ((early, late), (late, early), (sinks.merge_versions(early, late, ["id"]), early)):
        assert [tuple(r) for r in sinks.current(sinks.merge_versions(a, b, ["id"]), ["id"]).collect()] == [("k", "c", "b")]
    versions = spark.createDataFrame([("s", "e", "d", 1, 1), ("s", "e", "d", 5, 2)], "stt string, edt string, dim string, n int, ts int")
    assert [r.n for r in sinks.replace_latest(versions, ["dim"]).collect()] == [5]


def test_replace_partitions_touches_only_its_days(spark, tmp_path):
    path = str(tmp_path / "t")
    row = "id string, v int, t int, dt string"
    sinks.replace_partitions(spark, path, spark.createDataFrame([("a", 1, 1, "d1"), ("b", 1, 1, "d2")], row), ["id"], ["t"], "dt")
    for _ in range(2):  # a replayed batch changes nothing
        sinks.replace_partitions(spark, path, spark.createDataFrame([("a", 2, 2, "d1"), ("c", 1, 1, "d1")], row), ["id"], ["t"], "dt")
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 2), ("b", 1), ("c", 1)]


def test_replace_partitions_sets_nothing_in_the_session(spark, tmp_path):
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    sinks.replace_partitions(spark, f"{tmp_path}/t", spark.createDataFrame([("a", 1, "d")], "id string, t int, dt string"), ["id"], ["t"], "dt")
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode


def test_window_edges(spark):
    rows = spark.createDataFrame([(t,) for t in ("2024-01-01 00:00:09", "2024-01-01 00:00:10", "2024-01-01 00:00:19")], "t string").select(F.to_timestamp("t").alias("rt"))
    assert sorted((r.stt[-2:], r.register_ct) for r in windows.user_register(rows).collect()) == [("00", 1), ("10", 2)]


def test_traffic_flags_sum_up_the_union(spark):
    rows = page(spark, [("a", 1, None), ("a", 5, "home"), ("a", 30, None), ("b", 3, None), ("b", 20, "x"), ("b", 86400, None)])
    union = windows.traffic_rows(rows, logs.unique_visitors(rows), keyed.bounces(rows))
    got = [sorted(map(str, windows.traffic(x).collect())) for x in (union, windows.traffic_flags(rows))]
    assert got[0] == got[1]


def test_words_of_a_lexicon(spark):
    """Every listed word of random texts, against trying all of them; overlapping ones and unknown rests too."""
    rnd = random.Random(4)
    words = {"".join(rnd.choices("苹果手机壳a1b", k=rnd.randrange(1, 5))) for _ in range(40)}
    found = text.Lexicon(words)
    for _ in range(500):
        value = "".join(rnd.choices("苹果手机壳a1b c", k=rnd.randrange(30)))
        every = sorted(((a, a + len(w)) for w in words for a in range(len(value)) if value.startswith(w, a)), key=lambda x: (x[0], -x[1]))
        assert found.find(value) == every
        at, longest = 0, []
        while at < len(value):
            best = max((w for w in words if value.startswith(w, at)), key=len, default=None)
            longest += [(at, at + len(best))] if best else []
            at += len(best) if best else 1
        assert found.longest(value) == longest
    rows = spark.createDataFrame([("新款苹果手机壳 iPhone15 start",), (None,), ("",)], "s string")
    lexicon = ["苹果", "苹果手机", "手机", "手机壳", "iphone", "art", "iPhone15"]
    df = text.explode_words(rows, "s", lexicon=lexicon, fine=True)
    assert [r.keyword for r in df.collect()] == ["新款", "苹果手机", "苹果", "手机壳", "手机", "iphone15", "start"]
    assert "苹果" not in df._jdf.queryExecution().toString()


def test_a_large_lexicon(spark):
    """100,000 words go to the workers once; a long text takes time in proportion to its length."""
    rnd = random.Random(2)
    words = ["".join(chr(0x4E00 + rnd.randrange(400)) for _ in range(rnd.randrange(2, 5))) for _ in range(100_000)]
    found = text.Lexicon(words)
    known = set(words)
    value = "".join(chr(0x4E00 + rnd.randrange(400)) for _ in range(50_000))
    began = time.time()
    got = found.find(value)
    assert time.time() - began < 5
    assert got == sorted(((a, a + n) for a in range(len(value)) for n in (2, 3, 4) if a + n <= len(value) and value[a : a + n] in known), key=lambda x: (x[0], -x[1]))
    df = text.explode_words(spark.createDataFrame([(value[:2000],)] * 5, "s string"), "s", lexicon=words, fine=True)
    assert len(df._jdf.queryExecution().toString()) < 50_000 and df.count() > 5 * 500


def raw_lines(spark, tmp_path, n=3):
    lines = ['{"common":{"mid":"m1"},"start":{"entry":"icon"},"ts":5}', '{"common":{"mid":"m2"},"page":{"page_id":"home"},"displays":[{"item":"1"},{"item":"2"}],"actions":[{"action_id":"a","ts":7}],"err":{"error_code":9},"ts":6}', "not json", '{"common":{"mid":null},"ts":1}', '{"common":{"mid":"m3"},"page":{"page_id":"cart"},"displays":[],"ts":8}']
    for i in range(n):
        spark.createDataFrame([(x.replace("m1", f"m1{i}"),) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{tmp_path}/raw")
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(f"{tmp_path}/raw")


COUNTS = {"error": 1, "start": 1, "display": 2, "action": 1, "page": 2, "dirty": 2}


def test_log_outputs_in_one_pass(spark, tmp_path):
    raw = raw_lines(spark, tmp_path)
    jobs.log_outputs(raw, f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True).awaitTermination()
    jobs.log_outputs(raw, f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True).awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out")
    assert {r.kind: r["count"] for r in rows.groupBy("kind").count().collect()} == {k: 3 * n for k, n in COUNTS.items()}
    assert {r.display.item for r in logs.of_kind(rows, "display").collect()} == {"1", "2"} and logs.of_kind(rows, "error").first().err.error_code == 9
    assert {r.value for r in logs.of_kind(rows, "dirty").collect()} == {"not json", '{"common":{"mid":null},"ts":1}'} and logs.of_kind(rows, "page").columns == ["common", "page", "ts"]
    batch = logs.fan_out(feeds.parse_lines(spark.read.text(f"{tmp_path}/raw")))
    assert batch._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1 and batch.count() == rows.count()


def test_log_topics_after_a_stop_between_two_outputs(spark, tmp_path):
    """A stop after any output: the batch comes again, and each row is there once."""
    raw, stops = raw_lines(spark, tmp_path), iter([2, 0, 5, 3])
    last = {}

    def run():
        left = next(stops, 99)

        def write(rows, kind):
            nonlocal left
            if left == 0:
                raise RuntimeError("stopped")
            left -= 1
            rows.write.mode("append").parquet(f"{tmp_path}/{kind}")
            last[kind] = rows.first()["batch"]

        jobs.log_topics(raw, write, lambda kind: last.get(kind, -1), f"{tmp_path}/cp", available_now=True).awaitTermination()

    for _ in range(9):
        try:
            run()
        except Exception:  # noqa: S112
            continue
    for kind, n in COUNTS.items():
        rows = spark.read.parquet(f"{tmp_path}/{kind}")
        assert rows.count() == 3 * n and {r.batch for r in rows.collect()} == {0, 1, 2}


def test_views_of_one_millisecond_have_an_order(spark):
    """Which of two views is the visit does not hang on how the rows lie, and the first views of hours follow the same order."""
    rows = [{"common": {"mid": "m", "vc": v, "ch": "c", "ar": "a", "is_new": "1"}, "page": {"page_id": p, "last_page_id": None, "during_time": 1}, "ts": 1000} for v, p in (("2", "home"), ("1", "cart"), ("1", "home"))]
    tie = ["common.vc", "page.page_id"]
    for made in (rows, rows[::-1]):
        page = spark.createDataFrame([json.loads(json.dumps(x)) for x in made], LOG)
        assert [(r.common.vc, r.page.page_id) for r in logs.unique_visitors(page, tie).collect()] == [("1", "cart")]
        assert [r.vc for r in windows.traffic_flags(page, 10, tie).where("uv_ct = 1").collect()] == ["1"]
