"""Every registered query of the engine against its SQL."""

import pytest
from conftest import SMALL, same_rows

from driftmap import queries

ROWS_ONLY = sorted(set(queries.QUERIES) - set(queries.ORACLES))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SMALL), duck.sql(queries.ORACLES[name]))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0
