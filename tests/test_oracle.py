"""Every query of the engine's own operators runs, and gives the rows of its SQL."""

import pytest
from geobucket import queries as own

from .support import DATA, rows_of, sql_rows

SF = DATA / "sf0.001"


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, name):
    found = rows_of(own.queries()[name](spark, str(SF)))
    sql = own.oracle_sql().get(name)
    if sql is None:
        assert found
    else:
        assert found == sql_rows(sql, SF)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
