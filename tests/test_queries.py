"""Every query against its SQL; those without SQL for what must hold of them."""

import pytest

from spindrift.plans import ORACLE_SQL, QUERIES
from tests.duck import SF, connection, of_spark, of_sql


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, con, name):
    assert of_spark(QUERIES[name](spark, SF)) == of_sql(con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["next_access", "kalman_velocity", "clustered_search", "diversified_search"])
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
