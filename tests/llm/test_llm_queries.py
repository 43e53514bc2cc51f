from pathlib import Path

import pytest
from conftest import SF, same_as_sql

from quarrylight.llm.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_sql_agrees(spark):
    assert same_as_sql(spark, list(SQL), QUERIES, SQL) == []


def test_others_run(spark):
    for name in set(QUERIES) - set(SQL):
        QUERIES[name](spark, SF).limit(3).count()
