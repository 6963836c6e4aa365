"""Queries of the corpus operators that SQL can express give the rows of their SQL."""

import pytest
from geobucket.llm import queries as llm

from ..support import DATA, rows_of, sql_rows


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query(spark, name):
    sf = DATA / "sf0.01"
    assert rows_of(llm.queries()[name](spark, str(sf))) == sql_rows(llm.oracle_sql()[name], sf)
