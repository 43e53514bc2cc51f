"""Written intermediate tables: they cut lineage and survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names.

    Where that is unset, a session on one machine (tests) gets a temporary folder of its own; on a cluster it is an error, as
    a folder of one machine would not be seen by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if context.applicationId not in _own:
            _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='spark-scratch-')}"
        named = _own[context.applicationId]
    return f"{named.rstrip('/')}/{uuid.uuid4().hex}"


def write_out(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and return what was written, with exact sizes for the planner."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Growing:
    """A table in the shared folder that grows by appending; ``df`` reads what is there by now."""

    def __init__(self, first: DataFrame):
        self.spark, self.schema, self.path = first.sparkSession, first.schema, scratch_dir(first.sparkSession)
        self.add(first)

    def add(self, more: DataFrame) -> None:
        more.select(*self.schema.names).write.mode("append").parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)
