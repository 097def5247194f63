import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return brute.corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, brute.DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], brute.DOCS)


@pytest.fixture(scope="session")
def texts(rows):
    return [(r[0], r[1]) for r in rows]


def order(rows):
    return sorted(rows, key=repr)


pytest.order = order
