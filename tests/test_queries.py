"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import re

import pytest
from compare import differences, duck

import __spark_entry__ as registered

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


OWN = [n for n in registered.queries() if n != "pipeline" and not re.match(r"op\d+_", n)]


def test_every_query_has_sql():
    assert set(OWN) <= registered.oracle_sql().keys() <= registered.queries().keys()


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_sql(spark, con, name):
    assert not differences(registered.queries()[name](spark, SF), con, registered.oracle_sql()[name])


def test_entry(spark):
    assert registered.entry(spark).count() == 150
