"""Every registered query beside its SQL, on the smallest tables."""

import os

import pytest
from driver_check import compare, duck

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    text, ok = compare(spark, con, FOLDER, name)
    if ok is None:
        pytest.skip(text)  # it runs; its values are tested elsewhere
    assert ok, text


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
