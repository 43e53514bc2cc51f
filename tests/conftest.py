from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


SF = "/root/testdata/sf0.001"


def same_as_sql(spark, names, queries, sql):
    """Names of queries whose rows differ from those of their SQL over the smallest tables."""
    import duckdb

    from compare import rows

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    bad = []
    for name in names:
        df = queries[name](spark, SF)
        r = con.execute(sql[name])
        cols = [d[0] for d in r.description]
        if sorted(cols) != sorted(df.columns) or rows(df.columns, df.collect()) != rows(cols, r.fetchall()):
            bad.append(name)
    return bad
