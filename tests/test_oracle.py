"""Every registered query against its SQL counterpart on another engine."""

import os

import pytest
from compare import LIBRARY, assert_same, connect

import oracle

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", LIBRARY)
def test_query_matches_sql(spark, con, name):
    assert_same(spark, con, name, SF_DIR)


def test_every_query_has_sql():
    assert set(LIBRARY) == oracle.oracle_sql().keys()
