"""Every registered query against its SQL on the small tables."""

import pathlib
import re

import oracle
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    with oracle.connection(SF) as c:
        yield c


def test_every_query_has_sql():
    without = set(entry.queries()) - set(entry.oracle_sql())
    # only training-data operators may have none; their own tests hold them against plain loops
    assert set(entry.oracle_sql()) <= set(entry.queries()) and all(re.fullmatch(r"op\d+_\w+|pipeline", n) for n in without)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query(spark, con, name):
    assert oracle.compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 11
