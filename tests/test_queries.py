"""Every query of the library against its SQL."""

import pytest

from meadowlark.plans.queries import QUERIES, SQL

from .compare import duck, same

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, connection, name):
    same(QUERIES[name](spark, FOLDER), connection, SQL[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
