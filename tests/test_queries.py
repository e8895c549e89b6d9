"""Every query of the message engine against its SQL."""

import pytest
from helpers import SMALL, duck_rows, spark_rows

from tideline import queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SMALL)) == duck_rows(queries.ORACLE_SQL[name], SMALL)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
