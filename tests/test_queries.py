"""Every query against its SQL counterpart, on the smallest tables."""

import pytest

from __spark_entry__ import entry
from cohort.plans import all_queries
from compare import differences

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SMALL), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_every_counterpart_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["segment", "delay", "subjects", "completed_share"] and df.count() > 0
