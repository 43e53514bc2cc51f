import pytest
from conftest import SF, same_as_sql

from quarrylight.plans import registry

pytestmark = pytest.mark.skipif(not __import__("pathlib").Path(SF).exists(), reason="no test tables")


def test_all_sql_agrees(spark):
    q, s = registry.queries(), registry.sql()
    assert set(s) <= set(q)
    assert same_as_sql(spark, list(s), q, s) == []


def test_the_others_run(spark):
    q, s = registry.queries(), registry.sql()
    for name in set(q) - set(s):
        assert q[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
