"""Positions and running totals over a whole ordered result, without one task that holds it all.

A window without partition keys would send every row to one task. Instead the
order key is cut into ranges at quantiles (a bounded list of literals), each range
is ordered on its own, and what stands before a range is added from a table with
one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, about, and ranges at most.
RANGE_ROWS, MOST_RANGES = 500_000, 1_000


def _ranges(df: DataFrame, key: str) -> list[int]:
    n = df.count()
    parts = min(MOST_RANGES, n // RANGE_ROWS + 1)
    if parts == 1:
        return []
    return sorted(set(df.select(F.percentile_approx(key, [k / parts for k in range(1, parts)], 10_000)).first()[0]))


def running(df: DataFrame, key: str, order: list[Column], value: Column, name: str, descending: bool = False, ranges: list[int] | None = None) -> DataFrame:
    """``df`` with the total of ``value`` over the rows up to and with each one; ``order`` begins with ``key``."""
    edges = _ranges(df, key) if ranges is None else ranges
    if not edges:
        over = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(name, F.sum(value).over(over))
    place = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(key)))
    dealt = df.withColumn("_range", -place if descending else place).withColumn("_value", value)
    sums = {r["_range"]: r["v"] or 0 for r in dealt.groupBy("_range").agg(F.sum("_value").alias("v")).collect()}
    before, total = {}, 0
    for k in sorted(sums):
        before[k] = total
        total += sums[k]
    base = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_range")) if before else F.lit(0)
    over = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn(name, F.sum("_value").over(over) + base).drop("_range", "_value")


def position(df: DataFrame, key: str, order: list[Column], name: str, descending: bool = False, ranges: list[int] | None = None) -> DataFrame:
    """``df`` with each row's place (from 1) in the whole order, which must be total."""
    return running(df, key, order, F.lit(1).cast("long"), name, descending, ranges)
