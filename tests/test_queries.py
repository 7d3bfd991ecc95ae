"""Every query with SQL gives the SQL's rows."""

import pytest
from conftest import DATA, rows_of

from refsift.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, oracle, name):
    got = QUERIES[name](spark, DATA)
    want = oracle.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    said = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert rows_of([r.asDict() for r in got.collect()], columns) == rows_of(said, columns)


def test_ratio_is_between_0_and_1(spark):
    rows = QUERIES["title_ratio"](spark, DATA).collect()
    assert rows and all(0 <= r["ratio"] <= 1 for r in rows)
