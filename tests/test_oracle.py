"""Every registered query against its SQL, over whole tables."""

from __future__ import annotations

import __spark_entry__ as registry
import pytest
from compare import canonical, sql_connection
from conftest import SF_CHECK, SF_SMALL

from rolloom.plans.oracle import ORACLE
from rolloom.plans.queries import QUERIES



@pytest.fixture(scope="module")
def connection():
    return sql_connection(SF_CHECK)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(registry.queries()) and set(ORACLE) <= set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    expected = canonical(connection.sql(ORACLE[name]).df())
    assert canonical(QUERIES[name](spark, SF_CHECK).toPandas()) == expected
    assert expected[2]


def test_entry(spark):
    rows = registry.entry(spark)
    assert rows.columns[:2] == ["prompt_id", "n_rollouts"]
    counted = sql_connection(SF_SMALL).sql(
        "SELECT count(*) FROM conversations WHERE role = 'assistant'"
    )
    assert rows.count() == counted.fetchall()[0][0]
