"""Joins that stay balanced when one key holds a large part of the rows, and the valid version of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys count as heavy, the most frequent ones: they may be broadcast at any scale.
HEAVY_KEYS = 1000
#: Keys below so many rows never count as heavy.
HEAVY_ROWS = 20_000


def spread(df: DataFrame) -> DataFrame:
    """More partitions where a small file came in fewer than there are cores; large inputs stay as they were read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def heavy_keys(df: DataFrame, key: str, weight: str | None = None, most: int = HEAVY_KEYS, least: int = HEAVY_ROWS) -> DataFrame | None:
    """The up to ``most`` keys with the most rows (or ``weight``), none with fewer than ``least``; None if there are none.

    Counts are combined before the shuffle; the driver sees at most ``most`` keys. Null keys are not counted.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(n.alias("n")).where(F.col("n") >= least)
    found = counts.orderBy(F.desc("n"), key).limit(most).select(key).toArrow()
    return df.sparkSession.createDataFrame(found, df.select(key).schema) if found.num_rows else None


def split_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "left", weight: str | None = None, most: int = HEAVY_KEYS, least: int = HEAVY_ROWS, hot: DataFrame | None | bool = True
) -> DataFrame:
    """``left`` joined with ``right`` (one row per key) on ``key``: heavy keys of ``left`` by broadcast, the rest by shuffle.

    The right rows of heavy keys are at most ``most``, whatever the input. ``how`` is "left" or "inner"; rows of a null
    key stay in a left join without a partner. The result has the key once, then the other columns of both sides. Where the
    heavy keys are known beforehand, ``hot`` (or None) saves counting them.
    """
    if hot is True:
        hot = heavy_keys(left, key, weight, most, least)
    if hot is None:
        return left.join(right, key, how)
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    heavy = left.join(F.broadcast(hot), key, "left_semi").join(few, key, how)
    rest = left.join(F.broadcast(hot), key, "left_anti").join(right, key, how)
    return heavy.unionByName(rest)


def valid_version(df: DataFrame, key: str, loaded: str = "loaded_at") -> DataFrame:
    """The row of each key with the greatest ``loaded`` (rows that share it are identical), and ``first_loaded`` of the key.

    One partial aggregation instead of a window, so a key with very many versions needs no sort of them in one task.
    Rows without a key are left out; a null ``loaded`` counts as oldest.
    """
    rest = [c for c in df.columns if c not in (key, "first_loaded")]
    at = F.coalesce(F.col(loaded), F.lit("0001-01-01").cast("timestamp").cast(df.schema[loaded].dataType))
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("_v"), F.min(loaded).alias("first_loaded"))
    return best.select(key, *[F.col("_v")[c].alias(c) for c in rest], "first_loaded")
