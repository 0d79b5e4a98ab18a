"""The queries that have a SQL twin, on the smallest data."""

import pytest

from termweave.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    out = duck.execute(SQL[name])
    names = [c[0] for c in out.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(out.fetchall())
