"""Event time as whole microseconds since the epoch, and reference seconds as ticks of them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3_600 * SECOND


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since the epoch, whatever the session's time zone: times without a zone are never cast to one."""
    kind = dict(df.dtypes)[column]
    if kind == "timestamp_ntz":
        return F.expr(f"unix_date(CAST(`{column}` AS DATE)) * 86400000000L + EXTRACT(HOUR FROM `{column}`) * 3600000000L + EXTRACT(MINUTE FROM `{column}`) * 60000000L + CAST(EXTRACT(SECOND FROM `{column}`) * 1000000 AS BIGINT)")
    if kind == "timestamp":
        return F.unix_micros(F.col(column))
    return F.col(column).cast("long")


def stored_between(df: DataFrame, column: str, lo: int, hi: int) -> Column:
    """The closed interval as a test of the stored column with literals of its own type, which files can be skipped by."""
    kind = dict(df.dtypes)[column]
    if kind == "timestamp_ntz":
        low, high = (F.expr(f"timestamp_ntz'{datetime(1970, 1, 1) + timedelta(microseconds=x)}'") for x in (lo, hi))
    elif kind == "timestamp":
        low, high = F.timestamp_micros(F.lit(lo)), F.timestamp_micros(F.lit(hi))
    else:
        low, high = F.lit(lo), F.lit(hi)
    return F.col(column).between(low, high)


def seconds_part(t_us: Column) -> Column:
    return F.floor(t_us / SECOND)


def nanos_part(t_us: Column) -> Column:
    return F.pmod(t_us, F.lit(SECOND)) * 1000


def float_seconds(t_us: Column) -> Column:
    """Time as a double of seconds."""
    return t_us / F.lit(float(SECOND))


def whole_second(us: int) -> int:
    """Floored to the whole second, as an offset window's origin is in a container."""
    return us - us % SECOND
