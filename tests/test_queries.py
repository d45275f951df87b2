"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    ok, said = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert ok, said


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["lang", "quality", "segments"] and df.count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
