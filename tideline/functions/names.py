"""File names in natural order, and headers that may arrive as bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffix of a split that is being written.
ACTIVE = ".active"


def natural_number(name: Column) -> Column:
    """The first number in a name, by which split files are ordered; names without one come first."""
    return F.regexp_extract(name, "([0-9]+)", 1).try_cast("int")


def natural_prefix(name: Column) -> Column:
    return F.regexp_extract(name, "^([^0-9]*)", 1)


def is_active(name: Column) -> Column:
    return name.endswith(ACTIVE)


def decoded_header(header: Column) -> Column:
    """A header whose values arrived as UTF-8 bytes, with string values."""
    return F.transform_values(header, lambda _, v: F.decode(v, "UTF-8"))
