"""Readers and stream sinks on small files."""

from __future__ import annotations

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidemart.operators import changes as C
from tidemart.operators import dims as D
from tidemart.operators import keyed
from tidemart.schemas import CHANGE, DICTIONARY, DIM_CONFIG, SUMMARIES
from tidemart.sources import feeds, sinks, store


def test_feeds_read_back_what_topics_hold(spark, tmp_path):
    rows = spark.createDataFrame([("shop", "t", "insert", "1", {"a": "x"}, None), ("shop", "t", "update", "2", {"a": "y"}, {"a": "x"})], CHANGE)
    sinks.as_topic(rows).write.text(f"{tmp_path}/topic")
    with open(f"{tmp_path}/topic/extra.txt", "w") as f:
        f.write("not json\n[1]\n\n")
    got = feeds.parse_changes(feeds.read_raw(spark, f"{tmp_path}/topic"))
    assert sorted((r.type, r.data["a"]) for r in got.collect()) == [("insert", "x"), ("update", "y")]
    assert feeds.read_raw(spark, f"{tmp_path}/topic", streaming=True).isStreaming
    assert sinks.as_topic(rows, key="ts").columns == ["key", "value"]


def test_dictionary_and_tombstones(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([("1101", "cash", "11", day, None)], "dic_code string, dic_name string, parent_code string, create_time timestamp, operate_time timestamp").write.parquet(f"{tmp_path}/dic")
    assert feeds.read_dictionary(spark, f"{tmp_path}/dic").first().dic_name == "cash"
    rows = spark.createDataFrame([("a", 1), (None, None)], "k string, v int")
    rows.write.parquet(f"{tmp_path}/t")
    assert feeds.read_table(spark, f"{tmp_path}/t", rows.schema).count() == 1


def test_jdbc_dictionary_and_sink(spark, tmp_path):
    """The database that comes with Spark stands in for the shop's."""
    jdbc = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "dbtable": "base_dic", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    day = datetime.datetime(2024, 1, 1)
    codes = spark.createDataFrame([("1101", "cash", "11", day, None), ("1102", "card", "11", day, day)], DICTIONARY)
    sinks.to_jdbc(codes.limit(1), **jdbc)
    sinks.to_jdbc(codes.where("dic_code = '1102'"), **jdbc)
    got = feeds.read_dictionary(spark, **jdbc)
    assert got.schema.names == DICTIONARY.names and sorted(tuple(r) for r in got.select("dic_code", "dic_name", "create_time").collect()) == [("1101", "cash", day), ("1102", "card", day)]


def test_upsert_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1, "d1"), ("a", 2, 2, "d1"), ("b", 3, 1, "d2")], "id string, v int, t int, dt string")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sinks.upsert_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp", ["id"], ["t"], "dt", available_now=True).awaitTermination()
    assert sorted((r.id, r.v) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", 2), ("b", 3)]


CONFIG = [("a", "dim_a", "id,x,y", None, None), ("b", "dim_b", "k,z", "k", None)]
BATCHES = [[("a", "5", {"id": "1", "x": "new"}), ("b", "1", {"k": "9", "z": "q"})], [("a", "4", {"id": "1", "x": "old", "y": "kept"}), ("a", "x", {"id": "2", "y": "no time"}), ("a", "1", {"x": "no key"})]]


def test_dimension_tables_take_one_batch_after_the_other(spark, tmp_path):
    """Each change sets its own columns; late and repeated batches do no harm; a table for each line of the configuration."""
    config = spark.createDataFrame(CONFIG, DIM_CONFIG)
    dims = store.Dimensions(spark, f"{tmp_path}/dims", buckets=3)
    for i, rows in enumerate([*BATCHES, BATCHES[0]]):
        spark.createDataFrame([("shop", t, "update", ts, d, None) for t, ts, d in rows], CHANGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(CHANGE).parquet(f"{tmp_path}/in")
        store.dimension_stream(stream, lambda: config, dims, f"{tmp_path}/cp", available_now=True).awaitTermination()
        if i == 0:
            assert [tuple(r) for r in dims.table("dim_a", "id", ["x", "y"]).collect()] == [("1", "new", None)]
    a, b = config.orderBy("source_table").collect()
    assert sorted(tuple(r) for r in dims.of(a).collect()) == [("1", "new", "kept"), ("2", None, "no time")]
    assert [tuple(r) for r in dims.of(b).collect()] == [("9", "q")] and dims.table("dim_c", "id", ["x"]).count() == 0


def data_files(path):
    return {p: p.stat().st_mtime_ns for p in path.glob("data/**/*.parquet")}


def test_a_batch_writes_what_it_holds_and_replays_change_nothing(spark, tmp_path):
    config = spark.createDataFrame(CONFIG, DIM_CONFIG)
    dims = store.Dimensions(spark, f"{tmp_path}/d", buckets=4, most=3)
    routed = lambda rows: C.route(spark.createDataFrame([("shop", "a", "update", str(t), {"id": str(i), "x": f"{i} {t}"}, None) for i, t in rows], CHANGE), config)
    assert dims.append(routed([(i, 1) for i in range(400)]), ("s", 0))
    before = data_files(tmp_path / "d")
    for n in range(1, 6):
        assert dims.append(routed([(7, n + 1)]), ("s", n)) and not dims.append(routed([(7, n + 1)]), ("s", n))
    fresh = data_files(tmp_path / "d").keys() - before.keys()
    assert len(fresh) == 5 and sum(spark.read.parquet(str(p)).count() for p in fresh) == 10  # key and column of one row a batch
    assert data_files(tmp_path / "d").items() >= before.items()
    show = lambda: {r.id: r.x for r in dims.table("dim_a", "id", ["x"]).collect()}
    wanted = {str(i): f"{i} 1" for i in range(400)} | {"7": "7 6"}
    stale = dims.log.read()  # a reader that began before
    assert show() == wanted and len(dims.log.compact()) == 1  # only the bucket that has grown
    assert show() == wanted and stale.count() == 800 and max(map(len, dims.log.manifest()["live"].values())) == 1
    dims.log.clean(keep=1)
    assert show() == wanted and len(data_files(tmp_path / "d")) == 4 and dims.append(routed([(7, 0)]), ("s", 9)) and show() == wanted


def test_a_writer_that_stops_halfway_leaves_the_old_state(spark, tmp_path, monkeypatch):
    config = spark.createDataFrame(CONFIG, DIM_CONFIG)
    dims = store.Dimensions(spark, f"{tmp_path}/d", buckets=2, most=1)
    routed = lambda x: C.route(spark.createDataFrame([("shop", "a", "update", "1", {"id": "1", x: x}, None)], CHANGE), config)
    show = lambda: [tuple(r) for r in dims.table("dim_a", "id", ["x", "y"]).collect()]
    dims.append(routed("x"), ("s", 0))

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(dims.log, "_commit", stop)
        with pytest.raises(RuntimeError):
            dims.append(routed("y"), ("s", 1))
    assert show() == [("1", "x", None)]
    assert dims.append(routed("y"), ("s", 1)) and show() == [("1", "x", "y")]
    with monkeypatch.context() as m:
        m.setattr(dims.log, "_commit", stop)
        with pytest.raises(RuntimeError):
            dims.log.compact()
    assert show() == [("1", "x", "y")] and dims.log.compact() and show() == [("1", "x", "y")]
    stale = dims.log.manifest()  # a second writer finds the name taken
    with pytest.raises(Exception, match="FileAlreadyExists|already exists"):
        dims.log._commit(stale)
    dims.log.clean()
    assert show() == [("1", "x", "y")]


def test_summaries_are_compacted_by_day(spark, tmp_path):
    row = "stt string, edt string, kind string, n long, ts long, dt date"
    day = lambda d: datetime.date(2024, 1, d)
    of = lambda d, kind, n, ts: (f"2024-01-0{d} 00:00:00", f"2024-01-0{d} 00:00:10", kind, n, ts, day(d))
    table = store.summaries(spark, f"{tmp_path}/t", spark.createDataFrame([], row).schema, ["kind"], most=2)
    wanted: dict = {}
    for n in range(4):
        rows = [of(1, "a", n, n), of(1, None, 10 * n, n)] + ([of(2, "a", 5, n)] if n == 0 else [])
        wanted |= {(r[0], r[2]): r[3] for r in rows}
        assert table.append(spark.createDataFrame(rows, row), ("w", n))
        assert {(r.stt, r.kind): r.n for r in table.read().collect()} == wanted
    shown = table.read()
    untouched = {p for p in data_files(tmp_path / "t") if "dt=2024-01-02" in str(p)}
    assert table.compact() == ["by_dt=2024-01-01"] and {(r.stt, r.kind): r.n for r in shown.collect()} == wanted
    live = table.manifest()["live"]
    assert spark.read.parquet(f"{tmp_path}/t/data/{live['by_dt=2024-01-01'][0]}").count() == 2  # one row a window and kind
    table.clean(keep=1)
    assert untouched <= data_files(tmp_path / "t").keys() and {(r.stt, r.kind): r.n for r in table.read().collect()} == wanted
    assert table.read(dt=[day(2)]).count() == 1
    spark.createDataFrame([of(1, "a", 99, 9)], row).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(row).parquet(f"{tmp_path}/in")
    store.log_stream(stream, table, f"{tmp_path}/cp", available_now=True).awaitTermination()
    assert {(r.stt, r.kind): r.n for r in table.read().collect()} == wanted | {("2024-01-01 00:00:00", "a"): 99}


def test_last_rows_of_a_stream(spark, tmp_path):
    """What the rewriting sink gives, by batches that only append; repeated rows and late ones do no harm."""
    rows = [("a", 1, 1, "d1"), ("a", 2, 2, "d1"), ("b", 3, 1, "d2"), ("a", 0, 0, "d1"), ("b", 3, 1, "d2"), (None, 5, 1, None)]
    for r in rows:
        spark.createDataFrame([r], "id string, v int, t int, dt string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id string, v int, t int, dt string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    table = store.last_rows(spark, f"{tmp_path}/t", stream.schema, ["id"], ["t"], "dt", most=2)
    store.log_stream(stream, table, f"{tmp_path}/cp", available_now=True).awaitTermination()
    assert sorted(((r.id, r.v, r.dt) for r in table.read().collect()), key=str) == [("a", 2, "d1"), ("b", 3, "d2"), (None, 5, None)]
    assert max(map(len, table.manifest()["live"].values())) <= 2 and table.manifest()["batches"] == {"rows": 5}
    assert [r.v for r in table.read(dt=["d2"]).collect()] == [3]


def test_first_days_batch_by_batch_in_any_order(spark, tmp_path):
    """Day by day, in two orders, gives the flags of all days at once; a day without new users writes nothing."""
    rnd = random.Random(1)
    rows = [(rnd.choice(["u1", "u2", "u3", "u4", None]), datetime.datetime(2024, 1, 1 + d, rnd.randrange(24)), i) for d in range(4) for i in range(6)]
    df = spark.createDataFrame(rows, "user_id string, rt timestamp, id int")
    wanted = {(r.user_id, r.rt, r.id): r.n for r in keyed.unique_and_new(df, "user_id", "rt", ["id"], "u", "n").collect()}
    for name, days in (("up", [1, 2, 3, 4]), ("down", [3, 4, 2, 1])):
        firsts, parts = store.FirstDays(spark, f"{tmp_path}/{name}", buckets=2), {d: df.where(F.dayofmonth("rt") == d) for d in days}
        for d in days:
            firsts.add(parts[d], "user_id", F.to_date("rt"), ("days", d) if name == "up" else None)
        got = {(r.user_id, r.rt, r.id): r.n for d in days for r in firsts.flagged(parts[d], "user_id", "rt", ["id"], "n").collect()}
        assert got == wanted
        files = data_files(tmp_path / name)
        assert not firsts.add(parts[4].where("user_id IS NOT NULL"), "user_id", F.to_date("rt")) and len([p for p in data_files(tmp_path / name)]) == len(files)


def test_facts_move_to_the_buckets_of_a_dimension(spark, tmp_path):
    """A dimension too large to broadcast is not moved: one exchange, of the facts."""
    sku = spark.createDataFrame([(str(i), f"s{i}", "t", "c") for i in range(50)], "id string, spu_id string, tm_id string, category3_id string")
    name = f"sku_{uuid.uuid4().hex[:8]}"
    dim = store.bucketed(sku, name, "id", 4)
    rows = spark.createDataFrame([(i, str(i % 60)) for i in range(300)], "n int, sku_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = D.enrich_sku(rows, dim)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and joined.count() == 250
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sql(f"DROP TABLE {name}")


def test_versions_in_day_partitions(spark, tmp_path):
    row = "stt string, edt string, register_ct long"
    one = [("2024-01-01 00:00:00", "2024-01-01 00:00:10", 5), ("2024-01-02 00:00:00", "2024-01-02 00:00:10", 6)]
    for ts, rows in ((1, one), (1, one), (2, [(*one[0][:2], 7)])):  # the second is a replay
        sinks.append_versions(sinks.versioned(spark.createDataFrame(rows, row), SUMMARIES["user_register"], F.lit(ts)), f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    assert stored.count() == 5 and sorted(p.name for p in tmp_path.joinpath("t").glob("dt=*")) == ["dt=2024-01-01", "dt=2024-01-02"]
    assert sorted((r.stt[:10], r.register_ct) for r in sinks.replace_latest(stored.drop("dt"), []).collect()) == [("2024-01-01", 7), ("2024-01-02", 6)]
    spark.createDataFrame(one, row).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(row).parquet(f"{tmp_path}/in")
    sinks.versions_stream(stream, SUMMARIES["user_register"], F.lit(3), f"{tmp_path}/t", f"{tmp_path}/cp", available_now=True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/t").where("ts = 3").count() == 2


def test_versioned_rows_keep_the_sinks_columns(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-01 00:00:10", 5, "extra")], "stt string, edt string, register_ct long, helper string")
    out = sinks.versioned(rows, SUMMARIES["user_register"], F.lit(7))
    assert out.columns == ["stt", "edt", "register_ct", "ts", "dt"] and out.first().dt == datetime.date(2024, 1, 1)


def test_unknown_dimension_rows_go(spark):
    sku = spark.createDataFrame([("1", "s", "t", "c")], "id string, spu_id string, tm_id string, category3_id string")
    rows = spark.createDataFrame([("1",), ("2",), (None,)], "sku_id string")
    assert [(r.sku_id, r.trademark_id) for r in D.enrich_sku(rows, sku).collect()] == [("1", "t")]
