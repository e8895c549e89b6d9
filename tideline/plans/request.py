"""The request language: lines, their validation, and the plan each one stands for."""

from __future__ import annotations

import math
import re
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.scan import latest, ranged
from tideline.operators.windows import adaptive
from tideline.sources.container import Container, open_container

USAGE = "q topic.. length | qt topic.. from to | qa topic.. | BAG name | kill"


class RequestError(ValueError):
    """A line that is no valid request."""


@dataclass(frozen=True)
class Request:
    cmd: str
    abbrs: list[str] = field(default_factory=list)
    a: float | None = None
    b: float | None = None


#: What separates tokens, and what a number is, for lines and tables of lines alike.
BLANKS = " \t\n\x0b\f\r"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _number(token: str) -> float:
    value = float(token) if re.fullmatch(NUMBER[1:-1], token) else math.nan
    if not math.isfinite(value):
        raise RequestError(f"not a number: {token!r}")
    return value


def parse_request(line: str) -> Request:
    """One line as a request; RequestError says what is wrong with it."""
    tokens = [t for t in re.split(f"[{BLANKS}]+", line) if t]
    if not tokens:
        raise RequestError("empty request")
    cmd, rest = tokens[0], tokens[1:]
    if cmd == "kill" and not rest:
        return Request("kill")
    if cmd == "BAG" and len(rest) == 1:
        return Request("BAG", rest)
    if cmd == "q" and len(rest) >= 2:
        length = _number(rest[-1])
        if length < 0:
            raise RequestError("a window can't have negative length")
        return Request("q", rest[:-1], length)
    if cmd == "qt" and len(rest) >= 3:
        a, b = _number(rest[-2]), _number(rest[-1])
        if a > b:
            raise RequestError("a window can't end before it starts")
        return Request("qt", rest[:-2], a, b)
    if cmd == "qa" and rest:
        return Request("qa", rest)
    raise RequestError(f"invalid command, expected: {USAGE}")


def resolve(aliases: dict[str, str], names: list[str]) -> list[str]:
    """Topics of short names; an unknown one rejects the request."""
    unknown = [n for n in names if n not in aliases]
    if unknown:
        raise RequestError(f"unknown topic: {', '.join(unknown)}")
    return [aliases[n] for n in names]


def parse_requests(lines: DataFrame, column: str = "line") -> DataFrame:
    """The same grammar over a table of lines: cmd, abbrs, a, b and whether the line is valid."""
    tok = F.split(F.btrim(F.col(column), F.lit(BLANKS)), f"[{BLANKS}]+")
    n = F.size("tok")

    def number(k: int) -> Column:
        token = F.element_at("tok", k)
        value = F.when(token.rlike(NUMBER), token.try_cast("double"))
        return F.when(F.abs(value) < F.lit(math.inf), value)

    cmd = F.element_at("tok", 1)
    out = lines.withColumn("tok", tok).withColumn("cmd", cmd)
    two = F.col("cmd") == "qt"
    one = F.col("cmd") == "q"
    tail = F.when(two, 2).when(one, 1).otherwise(0)
    a = F.when(two & (n >= 4), number(-2)).when(one & (n >= 3), number(-1))
    b = F.when(two & (n >= 4), number(-1))
    out = out.withColumn("a", a).withColumn("b", b).withColumn("abbrs", F.slice("tok", 2, F.greatest(F.lit(0), n - 1 - tail)))
    valid = (
        F.when(two, (n >= 4) & F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") <= F.col("b")))
        .when(one, (n >= 3) & F.col("a").isNotNull() & (F.col("a") >= 0))
        .when(F.col("cmd") == "qa", n >= 2)
        .when(F.col("cmd") == "BAG", n == 2)
        .when(F.col("cmd") == "kill", n == 1)
        .otherwise(F.lit(False))
    )
    return out.withColumn("valid", F.coalesce(valid, F.lit(False))).drop("tok")


def unknown_aliases(requests: DataFrame, aliases: DataFrame) -> DataFrame:
    """(req_id, abbr) of names no dictionary has."""
    return requests.select("req_id", F.explode("abbrs").alias("abbr")).join(aliases, "abbr", "left_anti")


def with_topics(requests: DataFrame, aliases: DataFrame) -> DataFrame:
    """(req_id, abbr, topic) of requests."""
    return requests.select("req_id", F.explode("abbrs").alias("abbr")).join(aliases, "abbr")


class Session:
    """Answers request lines over one bound container.

    A container may grow: each request resolves its files and bounds anew. How long
    each line took to be planned is kept in ``took``; ``kill`` writes it to ``log``,
    if that is given.
    """

    def __init__(self, spark: SparkSession, aliases: dict[str, str], container: Container | None = None, root: str = "", dbm: float | None = None, log: str | None = None):
        self.spark, self.aliases, self.container, self.root, self.dbm, self.log, self.open = spark, aliases, container, root, dbm, log, True
        self.path: str | None = None
        self.took: list[tuple[str, float]] = []

    def run(self, line: str) -> DataFrame | None:
        """The rows a line asks for; None for commands that return none, and before a container is bound."""
        began = time.perf_counter()
        try:
            return self._run(parse_request(line))
        finally:
            self.took.append((line, time.perf_counter() - began))
            if not self.open and self.log:
                self.spark.createDataFrame(self.took, "line string, elapsed double").coalesce(1).write.mode("overwrite").json(self.log)

    def _run(self, r: Request) -> DataFrame | None:
        if r.cmd == "kill":
            self.open = False
            return None
        tick = self.container.tick if self.container else 1_000_000
        if r.cmd == "BAG":
            self.path = f"{self.root}/{r.abbrs[0]}"
            self.container = open_container(self.spark, self.path, tick)
            return None
        if self.container is None:
            return None
        topics = resolve(self.aliases, r.abbrs)
        if self.path:
            self.container = open_container(self.spark, self.path, tick) or self.container
        self.container.bounds(refresh=True)
        if r.cmd == "q":
            return latest(self.container, topics, r.a)
        if r.cmd == "qt":
            return ranged(self.container, topics, r.a, r.b)
        return adaptive(self.container, topics, dbm=self.dbm)

    def script(self, lines: list[str], pace: float = 0.0, limit: float | None = None) -> DataFrame | None:
        """All lines up to ``kill`` (the first may bind a container), as one result with the number of each line.

        Lines start at least ``pace`` seconds apart; after ``limit`` seconds no further one starts.
        """
        parts, began = [], time.monotonic()
        for k, line in enumerate(lines):
            if limit is not None and time.monotonic() - began > limit:
                break
            started = time.monotonic()
            got = self.run(line)
            if not self.open:
                break
            if got is not None:
                parts.append(got.withColumn("req_id", F.lit(k)))
            time.sleep(max(0.0, pace - (time.monotonic() - started)) if k + 1 < len(lines) else 0.0)
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts) if parts else None
