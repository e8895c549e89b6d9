"""Many windows at once: interval joins, prefix sweeps, budgets and rings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.link import UNWATCHED_CAP, byte_cap_of
from tideline.operators.ordered import running
from tideline.operators.scan import latest
from tideline.sources.container import Container

#: Requests are broadcast up to so many (each is a few numbers); more are joined by a shuffle on the same keys.
BROADCAST_REQUESTS = 200_000


def batch(rows: DataFrame, requests: DataFrame, bucket_us: int) -> DataFrame:
    """(req_id, row) of every message in a request's window; ``requests`` is (req_id, topic, lo, hi).

    A window is spread over fixed buckets of time, so the join has keys (topic,
    bucket) and stays a hash join however many windows there are; a message is in
    one bucket, so it meets a window once.
    """
    spread = requests.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / bucket_us), F.floor(F.col("hi") / bucket_us))))
    if requests.limit(BROADCAST_REQUESTS + 1).count() <= BROADCAST_REQUESTS:
        spread = F.broadcast(spread)
    keyed = rows.withColumn("bucket", F.floor(F.col("t_us") / bucket_us))
    return keyed.join(spread, ["topic", "bucket"]).where(F.col("t_us").between(F.col("lo"), F.col("hi"))).drop("bucket", "lo", "hi")


def batch_counts(rows: DataFrame, requests: DataFrame, bucket_us: int) -> DataFrame:
    """(req_id, n) of all requests, 0 for empty windows."""
    n = batch(rows, requests, bucket_us).groupBy("req_id").agg(F.count("*").alias("n"))
    return requests.select("req_id").join(n, "req_id", "left").select("req_id", F.coalesce("n", F.lit(0)).alias("n"))


def prefix_sweep(c: Container, topics: list[str] | None, ends: list[int]) -> DataFrame:
    """(e, topic, n): messages in [start, start + e] for every end.

    A message counts in all ends from the first that reaches it: messages are
    counted once by that first end, and the few counts are summed up.
    """
    lo, _ = c.bounds()
    if lo is None:
        return c.rows.select(F.lit(0).alias("e"), "topic", F.lit(0).cast("long").alias("n")).limit(0)
    rows = c.rows if topics is None else c.rows.where(F.col("topic").isin(topics))
    rows = rows.where(F.col("t_us") <= F.lit(lo + max(ends) * c.tick))
    reached = F.array_min(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: F.lit(lo) + e * F.lit(c.tick) >= F.col("t_us")))
    counted = rows.groupBy("topic", reached.alias("e")).agg(F.count("*").alias("n"))
    grid = rows.select("topic").distinct().withColumn("e", F.explode(F.array(*[F.lit(e) for e in ends])))
    upto = Window.partitionBy("topic").orderBy("e")
    return grid.join(counted, ["topic", "e"], "left").select("e", "topic", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n"))


def budget(rows: DataFrame, cap: int) -> DataFrame:
    """Newest first while the bytes already sent are within ``cap``: the message that crosses it is still sent."""
    sized = rows.withColumn("_size", F.octet_length("data"))
    order = [F.col("t_us").desc(), F.col("seq").desc()]
    total = running(sized, "t_us", order, F.col("_size"), "sent", descending=True)
    return total.withColumn("sent_before", F.col("sent") - F.col("_size")).where(F.col("sent_before") <= cap).drop("_size", "sent")


def adaptive(c: Container, topics: str | list[str] | None, length: float = 5, dbm: float | None = None, cap: int | None = None, watched: bool = True) -> DataFrame:
    """The latest window within what the link carries; 1 GiB if no link is watched."""
    allowed = cap if cap is not None else byte_cap_of(dbm) if watched else UNWATCHED_CAP
    return budget(latest(c, topics, length), allowed)


def latest_signal(signal: DataFrame, now: int) -> float | None:
    """The newest level at or before ``now`` (backward as-of), None if there is none."""
    return signal.where(F.col("t_us") <= now).agg(F.max_by("dbm", "t_us")).first()[0]


def ring(rows: DataFrame, key: str = "topic", n: int = 10) -> DataFrame:
    """The last ``n`` messages of each key; Spark limits each group before it shuffles."""
    order = Window.partitionBy(key).orderBy(F.col("t_us").desc(), F.col("seq").desc())
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
