"""Every query with SQL gives what DuckDB gives; the others give rows."""

import pytest
from helpers import DATA, canonical

from statsift import cases, route_queries  # noqa: F401  (register their queries)
from statsift.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = duck.execute(SQL[name]).df()
    assert len(want) and sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_without_optional_parts():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())
