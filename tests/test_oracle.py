"""Every registered query of the engine against its SQL on DuckDB."""

import pytest

from lakeloom.plans import registry
from tests.compare import rows

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, data):
    ours = QUERIES[name](spark, data).toPandas()
    if name in ORACLE:
        theirs = duck.sql(ORACLE[name]).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert rows(ours) == rows(theirs)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
