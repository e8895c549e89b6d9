"""Scans of a container: whole topics, trailing windows, offset windows, split layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.time import whole_second
from tideline.operators.ordered import position
from tideline.sources.container import Container, with_parts

#: The total order of messages.
ORDER = ["t_us", "conn_id", "seq"]


def of_topics(rows: DataFrame, topics: str | list[str] | None) -> DataFrame:
    """Messages of one topic or several; a list of literals, so whole partitions are skipped."""
    if topics is None:
        return rows
    return rows.where(F.col("topic").isin([topics] if isinstance(topics, str) else list(topics)))


def between(rows: DataFrame, lo: int | None, hi: int | None) -> DataFrame:
    """Messages in a closed time interval. An unknown bound (an empty container) selects nothing."""
    if lo is None or hi is None:
        return rows.where(F.lit(False))
    return rows.where(F.col("t_us").between(F.lit(int(lo)), F.lit(int(hi))))


def full(c: Container, topics: str | list[str] | None = None) -> DataFrame:
    return of_topics(c.rows, topics)


def latest_window(c: Container, length: float, end_slack: float = 0, clamp: bool = True) -> tuple[int | None, int | None]:
    """The last ``length`` seconds before the end, moved back by ``end_slack``; clamped at time 0."""
    _, end = c.bounds()
    if end is None:
        return None, None
    hi = end - round(end_slack * c.tick)
    lo = hi - round(length * c.tick)
    return (max(0, lo) if clamp else lo), hi


def latest(c: Container, topics: str | list[str] | None, length: float, end_slack: float = 0, clamp: bool = True) -> DataFrame:
    return of_topics(c.between(*latest_window(c, length, end_slack, clamp)), topics)


def ranged_window(c: Container, a: float, b: float, floor_origin: bool = True) -> tuple[int | None, int | None]:
    """Seconds ``a`` to ``b`` after the start, which is floored to the whole second in a container and isn't in splits."""
    start, _ = c.bounds()
    if start is None:
        return None, None
    origin = whole_second(start) if floor_origin else start
    return origin + round(a * c.tick), origin + round(b * c.tick)


def ranged(c: Container, topics: str | list[str] | None, a: float, b: float, floor_origin: bool = True) -> DataFrame:
    return of_topics(c.between(*ranged_window(c, a, b, floor_origin)), topics)


def first(c: Container, topics: str | list[str] | None, length: float) -> DataFrame:
    """Any one message of the window: reading stops as soon as there is one."""
    return latest(c, topics, length).limit(1)


def first_times(c: Container, topics: str | list[str] | None, length: float) -> DataFrame:
    return latest(c, topics, length).groupBy("topic").agg(F.min("t_us").alias("t_us"))


class Splits:
    """A container as fixed-duration splits, numbered from the first message by time."""

    def __init__(self, c: Container, duration: float = 10):
        self.c, self.duration_us = c, round(duration * c.tick)
        self.origin = c.bounds()[0] or 0
        self.rows = self._parts(c.rows)

    def _parts(self, rows: DataFrame) -> DataFrame:
        return rows if "part" in rows.columns else with_parts(rows, self.origin, self.duration_us)

    def part_of(self, t_us: int) -> int:
        return (t_us - self.origin) // self.duration_us

    def starts(self) -> DataFrame:
        """(part, start) of the splits that have messages."""
        return self.rows.groupBy("part").agg(F.min("t_us").alias("start"))

    def counts(self) -> DataFrame:
        return self.rows.groupBy("part").agg(F.count("*").alias("n"))

    def latest(self, topics: str | list[str] | None, length: float, mode: str = "exact") -> DataFrame:
        """Trailing window. ``reference`` mode looks into the last split alone when the window is no longer than one."""
        lo, hi = latest_window(self.c, length, clamp=False)
        if hi is None:
            return between(self.rows, None, None)
        last = self.part_of(hi)
        if mode == "reference" and round(length * self.c.tick) <= self.duration_us:
            begin = last
        else:
            begin = self.starts().where(F.col("start") < lo).agg(F.max("part")).first()[0] or 0
        return of_topics(self._parts(self.c.between(lo, hi)).where(F.col("part").between(begin, last)), topics)

    def ranged(self, topics: str | list[str] | None, a: float, b: float) -> DataFrame:
        """Offset window; the splits it can touch follow from its bounds, so the rest is never opened."""
        lo, hi = ranged_window(self.c, a, b, floor_origin=False)
        if lo is None:
            return between(self.rows, None, None)
        return of_topics(self._parts(self.c.between(lo, hi)).where(F.col("part").between(self.part_of(lo), self.part_of(hi))), topics)

    def reverse_walk(self, topics: str | list[str] | None, length: float, name: str = "pos") -> DataFrame:
        """Trailing window with the newest split first and time ascending inside a split."""
        rows = self.latest(topics, length)
        back = rows.withColumn("_back", -F.col("part"))
        return position(back, "_back", [F.col("_back"), F.col("t_us"), F.col("seq")], name).drop("_back")


def merge_order(rows: DataFrame, name: str = "pos") -> DataFrame:
    """Messages of several topics as one sequence in time."""
    return position(rows, "t_us", [F.col(c) for c in ORDER], name)
