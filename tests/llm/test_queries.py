"""The registered queries against their SQL."""

import re

import pytest

from lakeloom.llm import queries
from tests.compare import rows


def test_names():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 11))


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(name, spark, duck, data):
    ours = queries.QUERIES[name](spark, data).toPandas()
    assert len(ours) or name == "op8_decontam"
    if name in queries.ORACLE:
        theirs = duck.sql(queries.ORACLE[name]).df()
        assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)
