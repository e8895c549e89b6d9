"""All queries of the message engine over the driver's tables, with the SQL they are checked against.

``events`` is the message stream (topic = event_type, 20 robots) and one second
of a request stands for one hour; ``orders`` is a container of many equal times.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.link import SIGNAL_PATTERN, byte_cap, parse_dbm
from tideline.functions.names import decoded_header
from tideline.functions.time import HOUR, float_seconds, nanos_part, seconds_part
from tideline.operators import fleet, respond, scan, windows
from tideline.operators.aoi import aoi_avg, aoi_samples
from tideline.plans.request import Session, parse_requests, unknown_aliases, with_topics
from tideline.sources.container import Container, convert, open_container, read_splits, split_files
from tideline.sources import files
from tideline.sources.messages import connections, event_messages, event_table, order_table
from tideline.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

M = f"""WITH m AS (SELECT event_id AS seq, event_type AS topic, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS conn_id,
  CAST(user_id % 20 + 1 AS INT) AS robot_id, epoch_us(ts) AS t_us, props AS data, value FROM events),
b AS (SELECT min(t_us) AS lo, max(t_us) AS hi FROM m), k AS (SELECT CAST({HOUR} AS BIGINT) AS h) """
O = """WITH m AS (SELECT o_orderkey AS seq, o_orderpriority AS topic, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS conn_id,
  epoch_us(o_orderdate) AS t_us, o_orderstatus AS data FROM orders), b AS (SELECT min(t_us) AS lo, max(t_us) AS hi FROM m), k AS (SELECT CAST(86400000000 AS BIGINT) AS h) """
ROW = "seq, topic, conn_id, t_us"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> Container:
    table = event_table(spark, sf_dir)
    return Container(table.rows(), HOUR, table.within)


def orders(spark: SparkSession, sf_dir: str) -> Container:
    table = order_table(spark, sf_dir)
    return Container(table.rows(), 24 * HOUR, table.within)


def _ids(df: DataFrame) -> DataFrame:
    return df.select("seq", "topic", "conn_id", "t_us")


def _scratch(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints/tideline"
    return f"{root.rstrip('/')}/messages-{uuid.uuid4().hex}"


# Scans


@query(M + "SELECT topic, conn_id, count(*) AS n, min(t_us) AS t0, max(t_us) AS t1 FROM m GROUP BY 1, 2")
def topic_catalog(spark, sf_dir):
    return respond.catalog(events(spark, sf_dir).rows)


@query(M + "SELECT lo, hi FROM b")
def bag_bounds(spark, sf_dir):
    return events(spark, sf_dir).rows.agg(F.min("t_us").alias("lo"), F.max("t_us").alias("hi"))


@query(M + "SELECT seq, conn_id, octet_length(encode(data)) AS size FROM m WHERE topic = 'purchase'")
def full_scan(spark, sf_dir):
    return scan.full(events(spark, sf_dir), "purchase").select("seq", "conn_id", F.octet_length("data").alias("size"))


@query(M + f"SELECT {ROW} FROM m WHERE topic IN ('view', 'signup', 'error')")
def multi_topic_scan(spark, sf_dir):
    return _ids(scan.full(events(spark, sf_dir), ["view", "signup", "error"]))


@query(M + f"SELECT {ROW} FROM m, b, k WHERE t_us BETWEEN lo + 100 * h AND lo + 103 * h")
def absolute_range(spark, sf_dir):
    c = events(spark, sf_dir)
    lo, _ = c.bounds()
    return _ids(c.between(None if lo is None else lo + 100 * HOUR, None if lo is None else lo + 103 * HOUR))


@query(M + "SELECT seq, topic, json_extract_string(data, '$.page') AS page FROM m, b, k WHERE topic = 'view' AND t_us BETWEEN hi - 24 * h AND hi")
def decoded_scan(spark, sf_dir):
    from tideline.sources.messages import decoded

    return decoded(scan.latest(events(spark, sf_dir), "view", 24), "page string").select("seq", "topic", F.col("message.page").alias("page"))


@query(M + f"SELECT {ROW} FROM m, b, k WHERE topic IN ('click', 'view') AND t_us BETWEEN hi - 12 * h AND hi")
def q_latest(spark, sf_dir):
    return _ids(scan.latest(events(spark, sf_dir), ["click", "view"], 12))


@query(M + f"SELECT {ROW} FROM m, b, k WHERE topic = 'click' AND t_us BETWEEN hi - 13 * h AND hi - h")
def q_latest_slack(spark, sf_dir):
    return _ids(scan.latest(events(spark, sf_dir), "click", 12, end_slack=1, clamp=False))


@query(M + f"SELECT {ROW} FROM m, b, k WHERE topic = 'error' AND t_us BETWEEN greatest(0, hi - 1000000 * h) AND hi")
def q_latest_clamped(spark, sf_dir):
    return _ids(scan.latest(events(spark, sf_dir), "error", 1_000_000))


@query(M + f"SELECT {ROW} FROM m, b, k WHERE topic = 'click' AND t_us BETWEEN lo - lo % 1000000 + 4 * h AND lo - lo % 1000000 + 5 * h")
def qt_range(spark, sf_dir):
    return _ids(scan.ranged(events(spark, sf_dir), "click", 4, 5))


@query(O + f"SELECT {ROW} FROM m, b, k WHERE t_us BETWEEN hi - 3 * h AND hi")
def q_latest_ties(spark, sf_dir):
    return _ids(scan.latest(orders(spark, sf_dir), None, 3))


@query(M + "SELECT topic, min(t_us) AS t_us FROM m, b, k WHERE t_us BETWEEN hi - h AND hi GROUP BY topic")
def first_in_window(spark, sf_dir):
    return scan.first_times(events(spark, sf_dir), None, 1)


@query(M + "SELECT count(*) > 0 AS found FROM m, b, k WHERE topic = 'click' AND t_us BETWEEN hi - 24 * h AND hi")
def time_to_first(spark, sf_dir):
    return scan.first(events(spark, sf_dir), "click", 24).agg((F.count("*") > 0).alias("found"))


@query(M + f"SELECT {ROW}, row_number() OVER (ORDER BY t_us, conn_id, seq) AS pos FROM m, b, k WHERE t_us BETWEEN lo AND lo + 30 * h")
def merge_order(spark, sf_dir):
    return scan.merge_order(_ids(scan.ranged(events(spark, sf_dir), None, 0, 30, floor_origin=False)))


@query(O + f"SELECT {ROW}, row_number() OVER (ORDER BY t_us, conn_id, seq) AS pos FROM m, b, k WHERE t_us BETWEEN lo AND lo + 60 * h")
def merge_order_ties(spark, sf_dir):
    return scan.merge_order(_ids(scan.ranged(orders(spark, sf_dir), None, 0, 60, floor_origin=False)))


# Splits


@query(M + f"SELECT {ROW} FROM (SELECT *, (t_us - lo) // (10 * h) AS part FROM m, b, k) WHERE topic = 'click' AND part = (SELECT max((t_us - lo) // (10 * h)) FROM m, b, k) AND t_us BETWEEN hi - 5 * h AND hi")
def split_latest_short(spark, sf_dir):
    return _ids(scan.Splits(events(spark, sf_dir), 10).latest("click", 5, mode="reference"))


@query(M + f"SELECT {ROW} FROM m, b, k WHERE topic = 'click' AND t_us BETWEEN hi - 25 * h AND hi")
def split_latest_long(spark, sf_dir):
    return _ids(scan.Splits(events(spark, sf_dir), 10).latest("click", 25))


@query(M + f"SELECT {ROW} FROM m, b, k WHERE topic = 'view' AND t_us BETWEEN hi - 2500 * h AND hi")
def split_latest_all(spark, sf_dir):
    return _ids(scan.Splits(events(spark, sf_dir), 10).latest("view", 2500))


@query(M + f"SELECT {ROW} FROM m, b, k WHERE topic IN ('click', 'view') AND t_us BETWEEN lo + 13 * h AND lo + 34 * h")
def split_range(spark, sf_dir):
    return _ids(scan.Splits(events(spark, sf_dir), 10).ranged(["click", "view"], 13, 34))


@query(M + "SELECT CAST((t_us - lo) // (24 * h) AS INT) AS part, count(*) AS n FROM m, b, k GROUP BY 1")
def split_counts(spark, sf_dir):
    return scan.Splits(events(spark, sf_dir), 24).counts()


@query(M + "SELECT CAST((t_us - lo) // (10 * h) AS INT) AS part, min(t_us) AS start FROM m, b, k GROUP BY 1")
def split_starts(spark, sf_dir):
    return scan.Splits(events(spark, sf_dir), 10).starts()


@query(M + "SELECT seq, part, row_number() OVER (ORDER BY part DESC, t_us, seq) AS pos FROM (SELECT *, CAST((t_us - lo) // (10 * h) AS INT) AS part FROM m, b, k) WHERE t_us BETWEEN hi - 25 * h AND hi")
def reverse_walk(spark, sf_dir):
    return scan.Splits(events(spark, sf_dir), 10).reverse_walk(None, 25).select("seq", "part", "pos")


LISTING = "SELECT 'bag_' || i || '.bag' AS name FROM range(20) t(i) UNION ALL SELECT 'bag_20.bag.active'"


@query(f"SELECT name, CAST(regexp_extract(name, '([0-9]+)', 1) AS INT) AS n FROM ({LISTING}) WHERE NOT suffix(name, '.active')")
def natural_sort(spark, sf_dir):
    names = [f"bag_{i}.bag" for i in range(20)] + ["bag_20.bag.active"]
    return split_files(spark.createDataFrame([(n,) for n in names], "name string"))


# Requests

ALIASES = [("clk", "click"), ("vw", "view"), ("buy", "purchase")]
LINES = ["q clk 1", "qt clk vw 4 5", "qa buy", "BAG test.bag", "kill", "qt clk 6 5", "qt clk 5 5", "q", "q clk x", "nosuch 1"]


def _requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(LINES)), "req_id long, line string")


def _aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "abbr string, topic string")


@query(
    "WITH l(req_id, line) AS (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{x}')" for i, x in enumerate(LINES)) + "), "
    "t AS (SELECT *, string_split_regex(line, '\\s+') AS tok FROM l), u AS (SELECT *, len(tok) AS n, tok[1] AS cmd FROM t), "
    "v AS (SELECT *, CASE WHEN cmd = 'qt' AND n >= 4 THEN try_cast(tok[-2] AS DOUBLE) WHEN cmd = 'q' AND n >= 3 THEN try_cast(tok[-1] AS DOUBLE) END AS a, CASE WHEN cmd = 'qt' AND n >= 4 THEN try_cast(tok[-1] AS DOUBLE) END AS b FROM u) "
    "SELECT req_id, cmd, a, b, CAST(greatest(0, n - 1 - CASE cmd WHEN 'qt' THEN 2 WHEN 'q' THEN 1 ELSE 0 END) AS INT) AS n_abbrs, "
    "coalesce(CASE cmd WHEN 'qt' THEN n >= 4 AND a <= b WHEN 'q' THEN n >= 3 AND a >= 0 WHEN 'qa' THEN n >= 2 WHEN 'BAG' THEN n = 2 WHEN 'kill' THEN n = 1 ELSE false END, false) AS valid FROM v"
)
def request_parse(spark, sf_dir):
    return parse_requests(_requests(spark)).select("req_id", "cmd", "a", "b", F.size("abbrs").alias("n_abbrs"), "valid")


@query(M + "SELECT CAST(r AS BIGINT) AS req_id, a AS abbr, t AS topic, count(seq) AS n FROM (VALUES (0, 'clk', 'click'), (1, 'clk', 'click'), (1, 'vw', 'view'), (2, 'buy', 'purchase'), (6, 'clk', 'click')) x(r, a, t) LEFT JOIN m ON m.topic = t GROUP BY ALL")
def alias_join(spark, sf_dir):
    named = with_topics(parse_requests(_requests(spark)).where("valid and cmd in ('q', 'qa', 'qt')"), _aliases(spark))
    counts = respond.catalog(events(spark, sf_dir).rows).select("topic", "n")
    return named.join(counts, "topic", "left").select("req_id", "abbr", "topic", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT CAST(9 AS BIGINT) AS req_id, 'limage_raw' AS abbr")
def alias_missing(spark, sf_dir):
    lines = spark.createDataFrame([(8, "q clk 1"), (9, "q clk limage_raw 1")], "req_id long, line string")
    return unknown_aliases(parse_requests(lines), _aliases(spark))


TYPES = [("click", "Imu"), ("view", "Image"), ("purchase", "PointCloud2")]


@query(M + "SELECT topic, type, count(*) AS n FROM m JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in TYPES) + ") t(topic, type) USING (topic) GROUP BY 1, 2")
def type_lookup(spark, sf_dir):
    kinds = spark.createDataFrame(TYPES, "topic string, type string")
    return events(spark, sf_dir).rows.groupBy("topic").agg(F.count("*").alias("n")).join(F.broadcast(kinds), "topic").select("topic", "type", "n")


def _windows(spark: SparkSession, lo: int, topics: list[str]) -> DataFrame:
    n = len(topics)
    names = F.array(*[F.lit(t) for t in topics])
    return spark.range(100).select(F.col("id").alias("req_id"), F.element_at(names, (F.col("id") % n + 1).cast("int")).alias("topic"), (F.lit(lo) + (4 + 2 * F.col("id")) * HOUR).alias("lo"), (F.lit(lo) + (5 + 2 * F.col("id")) * HOUR).alias("hi"))


@query(M + "SELECT i AS req_id, count(t_us) AS n FROM range(100) r(i) CROSS JOIN b CROSS JOIN k LEFT JOIN m ON topic = 'click' AND t_us BETWEEN lo - lo % 1000000 + (4 + 2 * i) * h AND lo - lo % 1000000 + (5 + 2 * i) * h GROUP BY i")
def qt_batch_100(spark, sf_dir):
    c = events(spark, sf_dir)
    lo = c.bounds()[0] or 0
    return windows.batch_counts(c.rows, _windows(spark, lo - lo % 1_000_000, ["click"]), HOUR)


@query(M + "SELECT i AS req_id, seq, m.topic FROM range(100) r(i), b, k, m WHERE m.topic = CASE i % 2 WHEN 0 THEN 'click' ELSE 'view' END AND t_us BETWEEN lo + (4 + 2 * i) * h AND lo + (5 + 2 * i) * h")
def qt_batch_bucketed(spark, sf_dir):
    c = events(spark, sf_dir)
    return windows.batch(c.rows, _windows(spark, c.bounds()[0] or 0, ["click", "view"]), HOUR).select("req_id", "seq", "topic")


RANDOM = "SELECT i, 1 + (i * 7919 + 13) % 8 AS d, (i * 104729 + 7) % 101 AS s FROM range(50) t(i)"


@query(M + f"SELECT i AS req_id, count(t_us) AS n FROM ({RANDOM}) r CROSS JOIN b CROSS JOIN k LEFT JOIN m ON topic = 'view' AND t_us BETWEEN lo + s * h AND lo + (s + d) * h GROUP BY i")
def random_windows(spark, sf_dir):
    """Start 0 to 100, duration 1 to 8, from a fixed sequence."""
    c = events(spark, sf_dir)
    lo = c.bounds()[0] or 0
    i = F.col("id")
    begin, length = (i * 104729 + 7) % 101, 1 + (i * 7919 + 13) % 8
    r = spark.range(50).select(i.alias("req_id"), F.lit("view").alias("topic"), (F.lit(lo) + begin * HOUR).alias("lo"), (F.lit(lo) + (begin + length) * HOUR).alias("hi"))
    return windows.batch_counts(c.rows, r, 4 * HOUR)


@query(M + f"SELECT i AS req_id, count(t_us) AS n FROM (SELECT i, (i * 7919 + 13) % 13 AS d FROM range(50) t(i)) r CROSS JOIN b CROSS JOIN k LEFT JOIN m ON topic = 'click' AND t_us BETWEEN hi - d * h AND hi GROUP BY i")
def random_trailing(spark, sf_dir):
    """Trailing 0 to 12, from a fixed sequence."""
    c = events(spark, sf_dir)
    hi = c.bounds()[1] or 0
    r = spark.range(50).select(F.col("id").alias("req_id"), F.lit("click").alias("topic"), (F.lit(hi) - (F.col("id") * 7919 + 13) % 13 * HOUR).alias("lo"), F.lit(hi).alias("hi"))
    return windows.batch_counts(c.rows, r, 4 * HOUR)


@query(M + "SELECT CAST(40 + 5 * i AS INT) AS e, t.topic, count(m.t_us) AS n FROM range(17) r(i) CROSS JOIN b CROSS JOIN k CROSS JOIN (SELECT DISTINCT topic FROM m, b, k WHERE t_us <= lo + 120 * h) t LEFT JOIN m ON m.topic = t.topic AND t_us BETWEEN lo AND lo + (40 + 5 * i) * h GROUP BY 1, 2")
def prefix_sweep(spark, sf_dir):
    return windows.prefix_sweep(events(spark, sf_dir), None, list(range(40, 121, 5)))


# Responses


@query(M + "SELECT conn_id, count(*) AS n, CAST(sum(octet_length(encode(data))) AS BIGINT) AS bytes, string_agg(data, '' ORDER BY t_us, seq) AS payload FROM m, b, k WHERE topic IN ('click', 'view') AND t_us BETWEEN hi - 12 * h AND hi GROUP BY conn_id")
def response_pack(spark, sf_dir):
    return respond.pack(scan.latest(events(spark, sf_dir), ["click", "view"], 12)).select("conn_id", "n", "bytes", "payload")


@query(M + "SELECT string_agg(CAST(conn_id AS VARCHAR), ' ' ORDER BY ft, conn_id) || ' /' || CAST(sum(n) AS BIGINT) AS con_info FROM (SELECT conn_id, min(t_us) AS ft, count(*) AS n FROM m, b, k WHERE t_us BETWEEN hi - 12 * h AND hi GROUP BY 1)")
def con_info(spark, sf_dir):
    return respond.con_info(scan.latest(events(spark, sf_dir), None, 12))


@query(M + "SELECT topic, octet_length(encode(min_by(data, t_us))) AS first_size FROM m GROUP BY topic")
def first_size(spark, sf_dir):
    return respond.first_sizes(events(spark, sf_dir).rows)


@query(M + "SELECT topic, count(*) AS n, CAST(sum(octet_length(encode(data))) AS BIGINT) AS bytes FROM m, b, k WHERE t_us BETWEEN lo - lo % 1000000 + 10 * h AND lo - lo % 1000000 + 40 * h GROUP BY topic")
def window_metrics(spark, sf_dir):
    return respond.window_metrics(scan.ranged(events(spark, sf_dir), None, 10, 40))


@query(M + "SELECT seq, topic, CASE topic WHEN 'click' THEN 'Imu' WHEN 'view' THEN 'Image' ELSE 'std/String' END AS type FROM m WHERE topic IN ('click', 'error')")
def header_join(spark, sf_dir):
    rows = events(spark, sf_dir).rows
    heads = connections(spark, rows, {"click": "Imu", "view": "Image"})
    return scan.of_topics(rows, ["click", "error"]).join(F.broadcast(heads.drop("topic")), "conn_id").select("seq", "topic", F.col("header")["type"].alias("type"))


@query("SELECT CAST(i AS BIGINT) AS conn_id, 'topic_' || i AS topic FROM range(5) t(i)")
def header_decode(spark, sf_dir):
    raw = spark.range(5).select(F.col("id").alias("conn_id"), F.create_map(F.lit("topic"), F.encode(F.concat(F.lit("topic_"), F.col("id")), "UTF-8")).alias("header"))
    return raw.select("conn_id", decoded_header(F.col("header"))["topic"].alias("topic"))


# Budgets, rings, signals


@query(M + "SELECT seq, sent_before FROM (SELECT seq, coalesce(sum(octet_length(encode(data))) OVER (ORDER BY t_us DESC, seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sent_before FROM m, b, k WHERE t_us BETWEEN greatest(0, hi - 50 * h) AND hi) WHERE sent_before <= 500")
def qa_budget(spark, sf_dir):
    return windows.adaptive(events(spark, sf_dir), None, length=50, cap=500).select("seq", "sent_before")


@query(M + f"SELECT {ROW} FROM m, b, k WHERE t_us BETWEEN greatest(0, hi - 5 * h) AND hi")
def qa_default(spark, sf_dir):
    return _ids(windows.adaptive(events(spark, sf_dir), None))


@query("SELECT CAST(-d AS INT) AS dbm, CAST(floor(100e0 / 8e0 * 1048576 * (25e0 / CAST(d AS DOUBLE) * 15e-1)) AS BIGINT) AS cap FROM range(30, 91) t(d)")
def qa_signal_cap(spark, sf_dir):
    return spark.range(30, 91).select((-F.col("id")).cast("int").alias("dbm")).withColumn("cap", byte_cap(F.col("dbm")))


@query(f"SELECT dbm, count(*) AS n FROM (SELECT CAST(regexp_extract('Quality=58/70  Signal level=-' || (user_id % 90 + 1) || ' dBm', '{SIGNAL_PATTERN}', 1) AS INT) AS dbm FROM events) GROUP BY 1")
def signal_regex(spark, sf_dir):
    text = F.concat(F.lit("Quality=58/70  Signal level=-"), F.col("user_id") % 90 + 1, F.lit(" dBm"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(parse_dbm(text).alias("dbm")).groupBy("dbm").agg(F.count("*").alias("n"))


@query(M + "SELECT topic, CAST(max_by(-value, t_us) AS DOUBLE) AS dbm FROM m, b, k WHERE t_us <= hi - 100 * h GROUP BY topic")
def signal_asof(spark, sf_dir):
    """The newest level at or before a time (backward as-of)."""
    c = events(spark, sf_dir)
    hi = c.bounds()[1] or 0
    return c.rows.where(F.col("t_us") <= hi - 100 * HOUR).groupBy("topic").agg(F.max_by(-F.col("value"), "t_us").alias("dbm"))


@query(M + "SELECT topic, seq, t_us, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY t_us DESC, seq DESC) AS rn FROM m) WHERE rn <= 10")
def ring_last10(spark, sf_dir):
    return windows.ring(events(spark, sf_dir).rows).select("topic", "seq", "t_us", "rn")


@query(O + "SELECT topic, seq, t_us, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY t_us DESC, seq DESC) AS rn FROM m) WHERE rn <= 10")
def ring_ties(spark, sf_dir):
    return windows.ring(orders(spark, sf_dir).rows).select("topic", "seq", "t_us", "rn")


# Freshness

AOI = """, s AS (SELECT topic AS series, row_number() OVER w AS i, (t_us - min(t_us) OVER (PARTITION BY topic)) / 3600000000.0::DOUBLE AS t, value FROM m WINDOW w AS (PARTITION BY topic ORDER BY t_us, seq)),
p AS (SELECT series, i, t, t + value / 1000.0::DOUBLE AS tp, lag(t) OVER (PARTITION BY series ORDER BY i) AS before FROM s),
e AS (SELECT series, {hz} AS hz, min_by(tp, i) AS tp0, min_by(t, i) AS t0 FROM p GROUP BY 1),
g AS (SELECT series, hz, tp0, sum(CASE WHEN t < hz AND before IS NOT NULL THEN (t - before) * (tp - t) + {half} * (t - before) * (t - before) ELSE 0 END) AS steps, coalesce(max(CASE WHEN t < hz THEN t END), t0) AS tu FROM p JOIN e USING (series) GROUP BY series, hz, tp0, t0)
SELECT series, round(CASE WHEN hz <= tp0 THEN hz * hz / 2 ELSE ((2 * {d} + tp0) * tp0 - tp0 * tp0 + (hz - tu) * (hz - tu)) / (2 * hz) + steps / hz END, 4) AS aoi FROM g"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aoi_samples(events(spark, sf_dir).rows, "topic", "value", HOUR)


@query(M + AOI.format(hz="max_by(tp, i)", half="1", d="0"))
def aoi_average(spark, sf_dir):
    return aoi_avg(_samples(spark, sf_dir), digits=4)


@query(M + AOI.format(hz="max_by(tp, i)", half="0.5", d="0"))
def aoi_textbook(spark, sf_dir):
    return aoi_avg(_samples(spark, sf_dir), mode="textbook", digits=4)


@query(M + AOI.format(hz="200e0", half="1", d="653.499411e0"))
def aoi_horizon(spark, sf_dir):
    return aoi_avg(_samples(spark, sf_dir), delta0=653.499411, horizon=200.0, digits=4)


# Fleet

GROUPS = [(0, "click"), (0, "view"), (0, "error"), (1, "click"), (1, "purchase"), (2, "signup"), (3, "view"), (3, "signup")]


@query(M + "SELECT robot_id, topic, count(*) AS n FROM m WHERE (CAST((robot_id - 1) // 5 AS INT), topic) IN (" + ", ".join(f"({g}, '{t}')" for g, t in GROUPS) + ") GROUP BY 1, 2")
def fleet_hetero(spark, sf_dir):
    subs = spark.createDataFrame(GROUPS, "group_id int, topic string")
    return fleet.fleet_counts(fleet.hetero(events(spark, sf_dir).rows, subs))


@query(M + "SELECT robot_id, count(*) AS n FROM (SELECT *, max(t_us) OVER (PARTITION BY robot_id) AS own FROM m), k WHERE t_us >= own - 24 * h GROUP BY 1")
def fleet_latest(spark, sf_dir):
    """Each robot's last 24 hours by its own clock, in one plan."""
    rows = events(spark, sf_dir).rows
    ends = rows.groupBy("robot_id").agg(F.max("t_us").alias("own"))
    return rows.join(ends, "robot_id").where(F.col("t_us") >= F.col("own") - 24 * HOUR).groupBy("robot_id").agg(F.count("*").alias("n"))


@query(M + "SELECT robot_id, topic, count(*) AS n FROM m GROUP BY 1, 2")
def fleet_fanout(spark, sf_dir):
    """The same query on the stores of all robots, side by side."""
    rows = events(spark, sf_dir).rows
    stores = {i: rows.where(F.col("robot_id") == i).drop("robot_id") for i in range(1, fleet.FLEET + 1)}
    return fleet.fleet_query(stores, lambda one: one.groupBy("topic").agg(F.count("*").alias("n"))).select("robot_id", "topic", "n")


# Containers and streams


@query(M + "SELECT seq, topic, conn_id, robot_id, t_us, data, value, CAST((t_us - lo) // (48 * h) AS INT) AS part FROM m, b, k")
def container_roundtrip(spark, sf_dir):
    path = _scratch(spark)
    convert(event_messages(spark, sf_dir), path, 48 * HOUR)
    return open_container(spark, path, HOUR).rows.select("seq", "topic", "conn_id", "robot_id", "t_us", "data", "value", "part")


def _stored(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The event messages as plain files, for a stream to read."""
    path = _scratch(spark)
    rows = event_messages(spark, sf_dir)
    rows.write.parquet(path)
    return path, rows


def _drained(q) -> None:
    try:
        q.processAllAvailable()
        q.awaitTermination(120)
    finally:
        q.stop()


@query(M + f"SELECT {ROW} FROM m, b, k WHERE topic = 'click' AND t_us BETWEEN lo AND lo + 30 * h")
def sub_bounded(spark, sf_dir):
    path, rows = _stored(spark, sf_dir)
    lo = Container(rows).bounds()[0] or 0
    name = f"sub_{uuid.uuid4().hex}"
    _drained(live.subscribe(live.replay(spark, path, rows.schema), name, ["click"], lo, lo + 30 * HOUR))
    return _ids(spark.table(name))


@query(M + "SELECT topic, count(*) AS n FROM m, b, k WHERE topic IN ('click', 'view') AND t_us BETWEEN lo AND lo + 30 * h GROUP BY 1")
def sub_parallel(spark, sf_dir):
    path, rows = _stored(spark, sf_dir)
    lo = Container(rows).bounds()[0] or 0
    prefix = f"par_{uuid.uuid4().hex}"
    for q in live.parallel(live.replay(spark, path, rows.schema), ["click", "view"], lo, lo + 30 * HOUR, prefix):
        _drained(q)
    return spark.table(f"{prefix}_0").unionByName(spark.table(f"{prefix}_1")).groupBy("topic").agg(F.count("*").alias("n"))


@query(M + "SELECT topic, min(t_us) AS t_us FROM m GROUP BY 1")
def first_msg_stream(spark, sf_dir):
    path, rows = _stored(spark, sf_dir)
    name = f"first_{uuid.uuid4().hex}"
    _drained(live.first_times(live.replay(spark, path, rows.schema)).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start())
    return spark.table(name)


@query(M + f"SELECT {ROW} FROM m, b, k WHERE t_us BETWEEN lo AND lo + 30 * h")
def record_stream(spark, sf_dir):
    path, rows = _stored(spark, sf_dir)
    lo = Container(rows).bounds()[0] or 0
    out = _scratch(spark)
    _drained(live.record(live.replay(spark, path, rows.schema), out, out + "-log", None, lo, lo + 30 * HOUR))
    return _ids(spark.read.parquet(out))


@query(M + f"SELECT {ROW} FROM m, b, k WHERE topic IN ('click', 'error') AND t_us BETWEEN lo AND lo + 30 * h")
def record_topics(spark, sf_dir):
    path, rows = _stored(spark, sf_dir)
    lo = Container(rows).bounds()[0] or 0
    out = _scratch(spark)
    _drained(live.record(live.replay(spark, path, rows.schema), out, out + "-log", ["click", "error"], lo, lo + 30 * HOUR))
    return _ids(spark.read.parquet(out))


@query(M + "SELECT topic, CAST(rn AS BIGINT) AS rn, t_us, seq FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY t_us DESC, seq DESC) AS rn FROM m) WHERE rn <= 10")
def ring_stream(spark, sf_dir):
    """The rings after the last batch: later batches' rings replace earlier ones."""
    path, rows = _stored(spark, sf_dir)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    name = f"ring_{uuid.uuid4().hex}"
    try:
        batches = live.ring_stream(live.replay(spark, path, rows.schema, 1000))
        _drained(batches.writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).start())
    finally:
        spark.conf.set(key, before)
    return spark.table(name)


# Times, files, groups and sessions


@query(M + "SELECT seq, t_us // 1000000 AS secs, t_us % 1000000 * 1000 AS nsecs, t_us / 1000000.0::DOUBLE AS stamp FROM m")
def stamp_parts(spark, sf_dir):
    t = F.col("t_us")
    return events(spark, sf_dir).rows.select("seq", seconds_part(t).alias("secs"), nanos_part(t).alias("nsecs"), float_seconds(t).alias("stamp"))


@query(M + "SELECT DISTINCT substr(topic, 1, 2) AS abbr, topic FROM m")
def alias_file(spark, sf_dir):
    """Aliases written as one JSON object and read back."""
    pairs = events(spark, sf_dir).rows.select(F.substring("topic", 1, 2).alias("abbr"), "topic").distinct()
    path = _scratch(spark)
    pairs.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("abbr", "topic")))).alias("value")).coalesce(1).write.text(path)
    return files.load_aliases(spark, path)


@query(M + "SELECT DISTINCT 'q ' || topic || ' 1' AS line FROM m UNION ALL SELECT 'kill'")
def request_file(spark, sf_dir):
    path = _scratch(spark)
    lines = events(spark, sf_dir).rows.select(F.concat(F.lit("q "), F.col("topic"), F.lit(" 1")).alias("line")).distinct()
    lines.agg(F.concat_ws("\n", F.collect_list("line"), F.lit("\n"), F.lit("kill")).alias("value")).coalesce(1).write.text(path)
    return files.read_requests(spark, path).select("line")


@query(M + "SELECT CAST(row_number() OVER (ORDER BY topic) - 1 AS INT) AS tick, -CAST(count(*) AS DOUBLE) AS dbm FROM m GROUP BY topic")
def signal_file(spark, sf_dir):
    """Levels written as one JSON object and replayed in its order."""
    path = _scratch(spark)
    levels = events(spark, sf_dir).rows.groupBy("topic").agg((-F.count("*")).cast("double").alias("v"))
    levels.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", "v"))))).alias("value")).coalesce(1).write.text(path)
    return files.signal_replay(spark, path).select("tick", "dbm")


@query(M + AOI.format(hz="max_by(tp, i)", half="1", d="653.499411e0"))
def aoi_files(spark, sf_dir):
    """Samples written as files with their delta, read back and averaged by each file's own."""
    path = _scratch(spark)
    files.write_aoi(_samples(spark, sf_dir), path, delta=653.499411)
    return aoi_avg(files.read_aoi(spark, path), digits=4)


@query(M + "SELECT CAST((t_us - lo) // (48 * h) AS INT) AS part, count(*) AS n FROM m, b, k GROUP BY 1")
def split_directory(spark, sf_dir):
    """Foreign split files, one a split, with one still being written; numbers come from their names."""
    path, rows = _scratch(spark), events(spark, sf_dir)
    numbered = scan.Splits(rows, 48).rows
    for r in numbered.select("part").distinct().collect():  # one file a split is what this layout is
        one = f"{path}-{r.part}"
        numbered.where(F.col("part") == r.part).select("seq", "topic", "t_us").coalesce(1).write.parquet(one)
        _rename_part(spark, one, f"{path}/bag_{r.part}.parquet")
    _touch(spark, f"{path}/bag_99.parquet.active")
    return read_splits(spark, path).groupBy("part").agg(F.count("*").alias("n"))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _rename_part(spark: SparkSession, folder: str, to: str) -> None:
    """Give the one data file of a folder a name of its own."""
    source, fs = _fs(spark, folder)
    target, _ = _fs(spark, to)
    fs.mkdirs(target.getParent())
    found = next(f.getPath() for f in fs.listStatus(source) if f.getPath().getName().startswith("part-"))
    fs.rename(found, target)
    fs.delete(source, True)


def _touch(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.create(p).close()


TOPIC_GROUPS = [["click"], ["view"], ["purchase"], ["click", "view"], ["click", "signup", "error"]]
GROUP_ROWS = ", ".join(f"({g}, '{t}')" for g, ts in enumerate(TOPIC_GROUPS) for t in ts)


@query(M + f"SELECT i AS req_id, count(t_us) AS n FROM ({RANDOM}) r CROSS JOIN b CROSS JOIN k LEFT JOIN (m JOIN (VALUES {GROUP_ROWS}) g(g, topic) USING (topic)) ON g = i % 5 AND t_us BETWEEN lo + s * h AND lo + (s + d) * h GROUP BY i")
def random_groups(spark, sf_dir):
    """Historical windows over five groups of topics in turn."""
    return _grouped_windows(spark, sf_dir, trailing=False)


@query(M + f"SELECT i AS req_id, count(t_us) AS n FROM (SELECT i, (i * 7919 + 13) % 13 AS d FROM range(50) t(i)) r CROSS JOIN b CROSS JOIN k LEFT JOIN (m JOIN (VALUES {GROUP_ROWS}) g(g, topic) USING (topic)) ON g = i % 5 AND t_us BETWEEN hi - d * h AND hi GROUP BY i")
def trailing_groups(spark, sf_dir):
    """Trailing windows over five groups of topics in turn."""
    return _grouped_windows(spark, sf_dir, trailing=True)


def _grouped_windows(spark: SparkSession, sf_dir: str, trailing: bool) -> DataFrame:
    c = events(spark, sf_dir)
    lo, hi = (x or 0 for x in c.bounds())
    i = F.col("id")
    if trailing:
        begin, end = F.lit(hi) - (i * 7919 + 13) % 13 * HOUR, F.lit(hi)
    else:
        begin = F.lit(lo) + (i * 104729 + 7) % 101 * HOUR
        end = begin + (1 + (i * 7919 + 13) % 8) * HOUR
    names = F.array(*[F.array(*map(F.lit, ts)) for ts in TOPIC_GROUPS])
    r = spark.range(50).select(i.alias("req_id"), F.explode(F.get(names, (i % 5).cast("int"))).alias("topic"), begin.alias("lo"), end.alias("hi"))
    counts = windows.batch(c.rows, r, 4 * HOUR).groupBy("req_id").agg(F.count("*").alias("n"))
    return r.select("req_id").distinct().join(counts, "req_id", "left").select("req_id", F.coalesce("n", F.lit(0)).alias("n"))


@query(M + "SELECT CAST(t AS INT) AS threads, topic, count(*) AS n FROM m, b, k, (VALUES (1), (2), (4), (8), (16)) x(t) WHERE t_us BETWEEN hi - 24 * h AND hi GROUP BY ALL")
def concurrent_readers(spark, sf_dir):
    """The same question asked by 1 to 16 readers at once, each by its own thread and job; all of a round must agree."""
    c = events(spark, sf_dir)
    c.bounds()
    ask = lambda _: sorted(tuple(r) for r in scan.latest(c, None, 24).groupBy("topic").agg(F.count("*").alias("n")).collect())
    rows = []
    for threads in (1, 2, 4, 8, 16):
        with ThreadPoolExecutor(threads) as pool:
            answers = list(pool.map(ask, range(threads)))
        if any(a != answers[0] for a in answers):
            raise RuntimeError("readers disagree")
        rows += [(threads, *a) for a in answers[0]]
    return spark.createDataFrame(rows, "threads int, topic string, n long")


@query(M + "SELECT CAST(x.r AS INT) AS req_id, seq FROM m, b, k, (VALUES (1, 'click', 12), (2, 'view', 3)) x(r, t, d) WHERE topic = t AND t_us BETWEEN hi - d * h AND hi")
def session_script(spark, sf_dir):
    """A script whose first line binds a stored container, ended by kill."""
    path = _scratch(spark)
    convert(event_messages(spark, sf_dir), f"{path}/one.bag")
    s = Session(spark, dict(ALIASES), Container(events(spark, sf_dir).rows, HOUR), path, log=f"{path}/took")
    return s.script(["BAG one.bag", "q clk 12", "q vw 3", "kill", "q clk 1"]).select("req_id", "seq")
