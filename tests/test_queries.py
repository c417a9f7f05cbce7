"""Every registered query with an SQL twin, next to it, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from tapewright.plans import load
from tapewright.plans.registry import REGISTRY
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
load()
TWINS = sorted(n for n, q in REGISTRY.items() if q.sql is not None)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", TWINS)
def test_same_rows_as_sql(spark, con, name):
    q = REGISTRY[name]
    # Some need more bars a day than this size has; no rows on both sides is agreement too.
    problems = compare(q.run(spark, FOLDER), con, q.sql)
    assert not [p for p in problems if p != "no rows"]


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
