"""Every registered ledger query against its SQL, at the smallest scale."""

import os

import pytest
from compare import compare, duck

from tallymill import oracle, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry_lists_queries_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and len(e.oracle_sql()) > 50"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    compare(spark, queries.queries()[name], oracle.oracle_sql()[name], SF, con)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
