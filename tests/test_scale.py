"""What moves between tasks, and how much a task gets, as tables grow."""

from __future__ import annotations

import random
import re

import pytest

from tidemart.operators import changes as C
from tidemart.operators import facts, keyed, windows
from tidemart.plans import fixtures as X
from tidemart.plans.queries import QUERIES
from tidemart.schemas import CHANGE

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def large(spark):
    """Tables as large as they look to a session that broadcasts dictionaries alone."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2048")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moves(df):
    """Keys of the plan's shuffles."""
    return [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df))]


@pytest.mark.parametrize("name", ["dwd_order_pre_process", "dwd_order_detail", "dedup_first", "dedup_latest"])
def test_details_stay_with_their_order(large, name):
    keys = {tuple(k.split(", ")[:-1]) for k in moves(QUERIES[name](large, DATA))}
    assert keys - {("o_custkey",), ("c_custkey",)} == {("order_id",), ("o_id",)}


def test_trade_orders_move_as_orders_and_are_made_once(large):
    df = QUERIES["dws_trade_order_window"](large, DATA)
    assert [k for k in moves(df) if k.startswith("order_id")] == ["order_id, 4", "order_id, 4"]  # lines and the times of their orders
    assert plan(df).count("lineitem.parquet") == 1
    assert not any(k.startswith(("id,", "user_id,")) for k in moves(df))


def test_user_spu_orders_move_once_to_their_group(large, monkeypatch):
    monkeypatch.setattr(X, "ROWS_A_TASK", 1000)
    got = QUERIES["dws_user_spu_order_window"](large, DATA)
    assert [k for k in moves(got) if "user_id" in k] == ["user_id, spu_id, trademark_id, category3_id, 6"]
    monkeypatch.undo()
    assert sorted(got.collect()) == sorted(QUERIES["dws_user_spu_order_window"](large, DATA).collect())


def test_tasks_grow_in_number_with_the_lines(large, monkeypatch):
    few = QUERIES["dim_enrich_sku"](large, DATA)
    wanted = sorted(few.collect())
    monkeypatch.setattr(X, "ROWS_A_TASK", 1000)
    monkeypatch.setattr(X, "BROADCAST_PARTS", 10)
    lines = X.table(large, DATA, "lineitem").count()
    more = QUERIES["dim_enrich_sku"](large, DATA)
    n = -(-lines // 1000)
    assert n > 4 and {k for k in moves(more) if k.startswith(("order_id", "sku_id"))} == {f"order_id, {n}", f"sku_id, {n}"}
    assert sorted(more.collect()) == wanted


def test_activities_and_coupons_attached_inside_the_order(spark):
    pick = random.Random(5)
    rows = []
    for i in range(60):
        order, line = pick.choice(["1", "2", "3", None]), pick.choice(["a", "b", None])
        kind = pick.choice(["order_detail", "order_detail", "order_detail_activity", "order_detail_coupon"])
        detail = f"{order}-{line}" if order and line else None
        own = {"id": detail, "source_type": "2401", "sku_num": str(i)} if kind == "order_detail" else {"id": str(i), "order_detail_id": detail, "activity_id": f"A{i}", "coupon_id": f"C{i}"}
        rows.append(("shop", kind, "insert", "1700000000", {"order_id": order, **own}, None))
    rows += [("shop", "order_info", t, "1700000000", {"id": o, "user_id": o}, None) for o in "12" for t in ("insert", "update")]
    feed = spark.createDataFrame(rows, CHANGE)
    codes = spark.createDataFrame([("2401", "n")], "dic_code string, dic_name string")
    joined, inside = (facts.order_pre_process(feed, codes, by_order=b) for b in (False, True))
    text = lambda df: sorted(map(str, df.select(*sorted(joined.columns)).collect()))
    assert sorted(joined.columns) == sorted(inside.columns) and text(joined) == text(inside)
    assert joined.where("activity_id IS NOT NULL AND coupon_id IS NOT NULL").count() > 0
    with pytest.raises(ValueError):
        facts.order_pre_process(feed, codes, retention="1 DAY", by_order=True)


def test_changes_from_a_map_and_from_columns(spark):
    as_map = spark.createDataFrame([("shop", "t", "insert", "1", {"id": "7"}, None)], CHANGE)
    as_columns = as_map.selectExpr("database", "`table`", "type", "ts", "data['id'] AS id", "old").alias("data")
    assert [C.changes_of(f, "t", ("insert",), ["id"]).collect() for f in (as_map, as_columns)] == [[("7",)]] * 2


def test_flags_with_partitions_and_by_order(spark):
    pick = random.Random(3)
    made = [(pick.choice(["u", "v", None]), pick.choice(["2024-01-01 10:00:00", "2024-01-01 11:00:00", "2024-01-03 09:00:00", None])) for _ in range(20)]
    rows = [(f"{o}-{i}", str(o), *made[o], "1.50", "3", "0.25" if i else "x", None) for o in range(20) for i in range(3)]
    df = spark.createDataFrame(rows, "id string, order_id string, user_id string, t string, order_price string, sku_num string, split_activity_amount string, split_coupon_amount string")
    df = df.selectExpr("*", "CAST(t AS timestamp) AS rt")
    flag = lambda rows, n=None: keyed.unique_and_new(rows, "user_id", "rt", ["id"], "order_unique_user_count", "order_new_user_count", n)
    shown = ["id", "order_unique_user_count", "order_new_user_count"]
    flags = sorted(flag(df).select(*shown).collect())
    assert flags == sorted(flag(df, 3).select(*shown).collect()) and sum(r[2] for r in flags) == 2
    sums = sorted(windows.trade_order(flag(df), "1 day").collect())
    assert sums == sorted(windows.trade_order(flag(windows.trade_orders(df), 3), "1 day").collect()) and sums
