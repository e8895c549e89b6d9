"""Goldens, properties, edge cases and plans of the message engine."""

import json

import pytest
from helpers import SMALL, spark_rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.functions.link import byte_cap_of
from tideline.functions.time import HOUR
from tideline.operators import respond, scan, windows
from tideline.operators.aoi import aoi_avg
from tideline.operators.ordered import position, running
from tideline.plans.request import Request, RequestError, Session, parse_request, parse_requests, resolve
from tideline.sources import files
from tideline.sources.container import Container, convert, exists, open_container, split_files
from tideline.sources.messages import event_messages, order_messages

MESSAGE = "robot_id int, topic string, conn_id int, t_us long, seq long, data string"


@pytest.fixture(scope="module")
def box(spark):
    c = Container(event_messages(spark, SMALL).cache(), HOUR)
    c.bounds()
    return c


def seqs(df):
    return sorted(r.seq for r in df.select("seq").collect())


def test_requests_parse():
    assert parse_request("q imu 1") == Request("q", ["imu"], 1.0)
    assert parse_request("  qt imu cam 4 5 ") == Request("qt", ["imu", "cam"], 4.0, 5.0)
    assert parse_request("qa lcamera") == Request("qa", ["lcamera"])
    assert parse_request("BAG test.bag") == Request("BAG", ["test.bag"])
    assert parse_request("kill").cmd == "kill"
    for bad in ("", "q", "q 1", "qt imu 6 5", "q imu x", "BAGFORMAT x", "BAG", "kill now", "q imu -1"):
        with pytest.raises(RequestError):
            parse_request(bad)
    with pytest.raises(RequestError):
        resolve({"imu": "/imu"}, ["imu", "limage_raw"])


LINES = st.one_of(st.text(alphabet="q tabkilBAG0123456789.-+eE_\t\x1c", max_size=14), st.sampled_from(["q imu 1d", "qt imu 1f 2", "q imu 1_0", "q imu nan", "q imu inf", "q imu 1e999", "q imu 1e3", "q imu .5", "\tq imu 1."]))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(LINES, min_size=1, max_size=20))
def test_table_grammar_agrees_with_lines(spark, lines):
    got = {r.i: r.valid for r in parse_requests(spark.createDataFrame(list(enumerate(lines)), "i int, line string")).collect()}
    for i, line in enumerate(lines):
        try:
            parse_request(line)
            ok = True
        except RequestError:
            ok = False
        assert got[i] == ok, line


def test_aoi_goldens(spark):
    rows = [("s", i, float(t), float(tp)) for i, (t, tp) in enumerate([(0, 1), (2, 3), (5, 6)])]
    s = spark.createDataFrame(rows, "series string, i int, t double, tp double")
    value = lambda **k: aoi_avg(s, **k).first().aoi
    assert value() == pytest.approx(3.083333, abs=1e-6)
    assert value(horizon=4) == pytest.approx(2.0)
    assert value(horizon=0.5) == pytest.approx(0.125)
    assert value(mode="textbook") == pytest.approx(2.0)
    assert aoi_avg(s.limit(0)).count() == 0


def test_byte_cap():
    assert byte_cap_of(None) == byte_cap_of(-52) == 9452307
    assert byte_cap_of(0) == 1 << 30


@pytest.mark.parametrize("b", [0.5, 13, 100])
def test_ranges_add_up(spark, box, b):
    lo, _ = box.bounds()
    whole = seqs(scan.between(box.rows, lo, lo + 200 * HOUR))
    cut = lo + round(b * HOUR)
    assert whole == sorted(seqs(scan.between(box.rows, lo, cut)) + seqs(scan.between(box.rows, cut + 1, lo + 200 * HOUR)))


def test_longer_windows_hold_shorter_ones(spark, box):
    assert set(seqs(scan.latest(box, "click", 10))) <= set(seqs(scan.latest(box, "click", 100)))


@pytest.mark.parametrize("rows", ["events", "orders"])
def test_splits_lose_nothing(spark, rows):
    c = Container(event_messages(spark, SMALL) if rows == "events" else order_messages(spark, SMALL), HOUR)
    s = scan.Splits(c, 7)
    assert seqs(s.latest(None, 55)) == seqs(scan.latest(c, None, 55, clamp=False))
    assert seqs(s.ranged(None, 20, 90)) == seqs(scan.ranged(c, None, 20, 90, floor_origin=False))


def test_budget_grows_with_cap(spark, box):
    sent = [set(seqs(windows.adaptive(box, None, 200, cap=cap))) for cap in (0, 100, 1000, 10**9)]
    assert len(sent[0]) >= 1 and all(a <= b for a, b in zip(sent, sent[1:], strict=False))


def test_empty_container(spark):
    c = Container(spark.createDataFrame([], MESSAGE))
    assert c.bounds() == (None, None)
    for got in (scan.latest(c, "x", 5), scan.ranged(c, None, 1, 2), scan.Splits(c).latest(None, 5), scan.Splits(c).ranged(None, 1, 2), windows.adaptive(c, None), respond.pack(c.rows), windows.prefix_sweep(c, None, [1, 2])):
        assert got.count() == 0


def test_running_totals_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 101).alias("k"), "id")
    order = [F.col("k"), F.col("id")]
    one = spark_rows(position(df, "k", order, "p", ranges=[]))
    assert one == spark_rows(position(df, "k", order, "p", ranges=[10, 40, 90]))
    down = [F.col("k").desc(), F.col("id").desc()]
    assert spark_rows(running(df, "k", down, F.col("id"), "p", True, [])) == spark_rows(running(df, "k", down, F.col("id"), "p", True, [5, 50]))


def test_ties_have_a_total_order(spark):
    rows = scan.merge_order(order_messages(spark, SMALL))
    assert rows.select("pos").distinct().count() == rows.count()


def test_container_prunes(spark, tmp_path, box):
    path = str(tmp_path / "bag")
    convert(box.rows, path, 48 * HOUR)
    c = open_container(spark, path, HOUR)
    assert seqs(c.rows) == seqs(box.rows) and exists(spark, path)
    plan = scan.Splits(c, 48).ranged("click", 10, 60)._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "topic" in filters and "part" in filters
    pushed = plan.split("PushedFilters:")[1]
    assert "GreaterThanOrEqual(t_us" in pushed and "LessThanOrEqual(t_us" in pushed
    with pytest.raises(Exception, match="exist"):
        convert(box.rows, path)


def test_batch_is_a_hash_join(spark, box):
    r = spark.createDataFrame([(1, "click", 0, 10)], "req_id int, topic string, lo long, hi long")
    assert "BroadcastHashJoin" in windows.batch(box.rows, r, HOUR)._jdf.queryExecution().executedPlan().toString()


def test_ring_is_limited_before_the_shuffle(spark, box):
    assert "WindowGroupLimit" in windows.ring(box.rows)._jdf.queryExecution().executedPlan().toString()


def test_session(spark, box, tmp_path):
    convert(box.rows, str(tmp_path / "one.bag"))
    s = Session(spark, {"clk": "click", "vw": "view"}, None, str(tmp_path))
    assert s.run("q clk 1") is None  # nothing is bound yet
    assert s.run("BAG nosuch.bag") is None and s.container is None
    s.run("BAG one.bag")
    s.container.tick = HOUR
    assert seqs(s.run("q clk vw 12")) == seqs(scan.latest(box, ["click", "view"], 12))
    assert s.run("qa clk").count() >= 0
    got = s.script(["q clk 12", "qt clk 4 50", "kill", "q clk 1"])
    assert {r.req_id for r in got.select("req_id").distinct().collect()} == {0, 1} and not s.open
    with pytest.raises(RequestError):
        Session(spark, {}, box).run("q nosuch 1")


def test_files(spark, tmp_path):
    (tmp_path / "alias.json").write_text(json.dumps({"imu": "/imu", "cam": "/cam"}))
    assert {tuple(r) for r in files.load_aliases(spark, str(tmp_path / "alias.json")).collect()} == {("imu", "/imu"), ("cam", "/cam")}
    (tmp_path / "q.req").write_text("q imu 1\nq cam 2\n\nkill\n")
    assert [r.line for r in files.read_requests(spark, str(tmp_path / "q.req")).orderBy("n").collect()] == ["q imu 1", "q cam 2", "kill"]
    d = tmp_path / "aoi"
    d.mkdir()
    (d / "a.aoi").write_text(json.dumps({"delta": 0.0, "time_sequence": [[0, 1], [2, 3], [5, 6]]}))
    (d / "b.aoi").write_text("not json")
    (d / "c.txt").write_text("{}")
    got = files.read_aoi(spark, str(d))
    assert {(r.series, r.n) for r in got.groupBy("series").agg(F.count("t").alias("n")).collect()} == {("a.aoi", 3), ("b.aoi", 0)}
    assert {r.series: r.aoi is None for r in aoi_avg(got).collect()} == {"a.aoi": False, "b.aoi": True}
    assert aoi_avg(got.where("series = 'a.aoi'")).first().aoi == pytest.approx(3.083333, abs=1e-6)
    files.write_aoi(got.where("t is not null"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().time_sequence == [[0.0, 1.0], [2.0, 3.0], [5.0, 6.0]]
    assert spark_rows(files.read_aoi(spark, str(tmp_path / "out"))) == spark_rows(got.where("t is not null"))
    (tmp_path / "signal.json").write_text(json.dumps({"a": -50, "b": -61}))
    assert [(r.tick, r.dbm) for r in files.signal_replay(spark, str(tmp_path / "signal.json")).collect()] == [(0, -50.0), (1, -61.0)]
    lines = spark.createDataFrame([("Signal level=-52 dBm",), ("nothing",)], "line string")
    assert [r.dbm for r in files.signal_text(lines).collect()] == [-52]


def test_natural_order(spark):
    names = spark.createDataFrame([("bag_10.bag",), ("bag_2.bag",), ("bag_3.bag.active",)], "name string")
    assert [r.name for r in split_files(names).collect()] == ["bag_2.bag", "bag_10.bag"]


def test_latest_signal(spark):
    s = spark.createDataFrame([(1, -40.0), (5, -60.0)], "t_us long, dbm double")
    assert windows.latest_signal(s, 4) == -40.0 and windows.latest_signal(s, 0) is None


def test_sampler_streams(spark):
    from tideline.streaming.live import sampler

    assert sampler(spark, "Signal level=-52 dBm").isStreaming


def test_windows_reach_the_stored_column(spark):
    from tideline import queries

    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    for name in ("q_latest", "qt_range", "absolute_range", "split_range", "q_latest_ties"):
        plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters: [")[1].split("]")[0]
        assert "GreaterThanOrEqual(" in pushed and "LessThanOrEqual(" in pushed, (name, pushed)
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_times_without_a_zone_stay_so(spark):
    from tideline.functions.time import micros, stored_between

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("SELECT * FROM VALUES (timestamp_ntz'2024-03-10 02:30:00'), (timestamp_ntz'2024-03-10 03:30:00.000001'), (timestamp_ntz'1969-12-31 23:59:59.5') t(ts)")
        want = [1710037800000000, 1710041400000001, -500000]
        assert [r.t for r in df.select(micros(df, "ts").alias("t")).collect()] == want
        assert [df.where(stored_between(df, "ts", t, t)).count() for t in want] == [1, 1, 1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_binary_payloads_are_packed(spark):
    rows = spark.createDataFrame([(1, "a", 0, 2, 1, b"\xff"), (1, "a", 0, 1, 2, b"\x00\xfe"), (1, "a", 0, 3, 3, None)], "robot_id int, topic string, conn_id int, t_us long, seq long, data binary")
    assert bytes(respond.pack(rows).first().payload) == b"\x00\xfe\xff"


def test_a_growing_container_is_read_anew(spark, tmp_path):
    path = str(tmp_path / "one.bag")
    row = lambda t, n: spark.createDataFrame([(1, "click", 0, t, n, "x")], MESSAGE)
    convert(row(10_000_000, 1), path)
    s = Session(spark, {"clk": "click"}, None, str(tmp_path), log=str(tmp_path / "took"))
    s.run("BAG one.bag")
    assert seqs(s.run("q clk 1")) == [1]
    row(99_000_000, 2).write.mode("append").partitionBy("topic").parquet(path)
    assert seqs(s.run("q clk 1")) == [2]
    s.run("kill")
    assert spark.read.json(str(tmp_path / "took")).count() == 4


def test_many_topics_are_joined(spark, monkeypatch):
    from tideline.sources import messages

    few = spark_rows(event_messages(spark, SMALL))
    monkeypatch.setattr(messages, "LITERAL_TOPICS", 2)
    assert spark_rows(event_messages(spark, SMALL)) == few
