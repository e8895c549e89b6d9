"""Link quality: signal levels out of text, and the byte budget they allow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The signal pattern, the level taken when nothing is known, and the constants of the budget formula.
SIGNAL_PATTERN = r"Signal level=(-?[0-9]+) dBm"
DEFAULT_DBM = -52
MEGABIT_BYTES = 100e0 / 8e0 * 1048576
FULL_SIGNAL, MARGIN = 25e0, 1.5e0
#: Budget when no link is watched: 1 GiB.
UNWATCHED_CAP = 1 << 30


def parse_dbm(text: Column) -> Column:
    """The level in dBm, null where the text has none."""
    found = F.regexp_extract(text, SIGNAL_PATTERN, 1)
    return F.when(found != "", found.cast("int"))


def byte_cap(dbm: Column) -> Column:
    """Bytes that a link of this level carries; unknown levels count as the default."""
    level = F.abs(F.coalesce(dbm, F.lit(DEFAULT_DBM)).cast("double"))
    return F.floor(F.lit(MEGABIT_BYTES) * (F.lit(FULL_SIGNAL) / level * F.lit(MARGIN))).cast("long")


def byte_cap_of(dbm: float | None) -> int:
    """The same for one level on the driver; a level of 0 allows what an unwatched link does."""
    level = abs(DEFAULT_DBM if dbm is None else dbm)
    return int(MEGABIT_BYTES * (FULL_SIGNAL / level * MARGIN)) if level else UNWATCHED_CAP
