"""References to rows that are missing, deleted or loaded later than the row that names them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.skew import HEAVY_KEYS, HEAVY_ROWS, heavy_keys, split_join
from quarrylight.scratch import write_out


def file_key(name: Column) -> Column:
    """A file name as names are compared: the last part of a path, ``%20`` as blank, trimmed, lower case; null if nothing is left."""
    last = F.regexp_replace(name, r"(?s)^.*[/\\]", "")
    return F.nullif(F.lower(F.regexp_replace(F.replace(last, F.lit("%20"), F.lit(" ")), r"(?U)^\s+|\s+$", "")), F.lit(""))


def whole_number(text: Column) -> Column:
    """The whole number that a sheet printed (outer blanks, leading zeros, trailing ``.0``) as bigint; null for other text."""
    return F.regexp_extract(text, r"(?U)^\s*(\d+)(?:\.0)?\s*$", 1).try_cast("bigint")


def target_status(versions: DataFrame, key: Column, loaded: str = "loaded_at", deleted: str = "deleted_at") -> DataFrame:
    """``key`` (string), whether its valid version is ``deleted``, and ``first_loaded``. Rows without a key are left out."""
    rows = versions.select(key.cast("string").alias("key"), F.col(loaded).alias("at"), F.col(deleted).isNotNull().alias("gone")).where(F.col("key").isNotNull())
    return rows.groupBy("key").agg(F.max_by("gone", "at").alias("deleted"), F.min("at").alias("first_loaded"))


def references(children: DataFrame, table: str, child_key: str, column: str, key: Column, loaded: str = "loaded_at") -> DataFrame:
    """One row per reference: child table and key, column, the key it names (string) and when the child was loaded."""
    return children.select(
        F.lit(table).alias("child_table"), F.col(child_key).cast("bigint").alias("child_key"), F.lit(column).alias("ref_column"), key.cast("string").alias("key"), F.col(loaded).alias("at")
    ).where(F.col("key").isNotNull())


def _reason(at: Column) -> Column:
    return F.when(F.col("deleted").isNull(), "missing").when(F.col("deleted"), "deleted").when(F.col("first_loaded") > at, "late")


_GROUP = ("child_table", "ref_column", "key", "period")


def orphan_keys(refs: DataFrame, targets: DataFrame, most: int = HEAVY_KEYS, least: int = HEAVY_ROWS) -> DataFrame:
    """Keys that references of a table, column and month fail on: those four, ``n`` (references), ``last`` and the target's status.

    References are counted per key and month first, with a partial count before the shuffle, so only one row per key and
    month meets the targets. The most frequent keys, at most ``most``, are checked by broadcast, the remaining ones by a
    shuffled anti-join against the targets that answer for the whole month; both are united. What failed, and no other key,
    then gets its target's status. Null keys are no references; a null load time gives a null period and is never late.
    """
    period = F.date_format("at", "yyyy-MM").alias("period")
    counted = refs.where(F.col("key").isNotNull()).groupBy("child_table", "ref_column", "key", period)
    counted = write_out(counted.agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last")))
    names, status = F.struct(*_GROUP, "n", "first", "last"), F.struct("key", "deleted", "first_loaded")
    answers = (F.col("l.key") == F.col("r.key")) & ~F.col("r.deleted") & ~F.coalesce(F.col("r.first_loaded") > F.col("l.first"), F.lit(False))

    hot = heavy_keys(counted, "key", weight="n", most=most, least=least)
    if hot is None:
        failed = counted.alias("l").join(targets.alias("r"), answers, "left_anti")
    else:
        few = F.broadcast(targets.join(F.broadcast(hot), "key", "left_semi"))  # at most ``most`` rows
        heavy = counted.join(F.broadcast(hot), "key", "left_semi").alias("l").join(few.alias("r"), answers, "left_anti")
        rest = counted.join(F.broadcast(hot), "key", "left_anti").alias("l").join(targets.alias("r"), answers, "left_anti")
        failed = heavy.unionByName(rest)
    seen = failed.select(names.alias("l"), F.col("key")).join(targets.select(status.alias("r"), F.col("key")), "key", "left")
    return seen.select(*[F.col("l")[c].alias(c) for c in (*_GROUP, "n", "last")], F.col("r.deleted").alias("deleted"), F.col("r.first_loaded").alias("first_loaded"))


def _rows(refs: DataFrame, failed: DataFrame, most: int, least: int) -> DataFrame:
    """The references behind keys that failed, with their reason; of a month in part late only the late ones."""
    group = F.concat_ws("\x01", "child_table", "ref_column", "key", F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("")))
    own = failed.select(F.concat_ws("\x01", "child_table", "ref_column", "key", F.coalesce("period", F.lit(""))).alias("group"), "deleted", "first_loaded")
    back = split_join(refs.where(F.col("key").isNotNull()).withColumn("group", group), own, "group", "inner", most=most, least=least)
    return back.withColumn("reason", _reason(F.col("at"))).where(F.col("reason").isNotNull())


def orphan_counts(refs: DataFrame, targets: DataFrame, most: int = HEAVY_KEYS, least: int = HEAVY_ROWS) -> DataFrame:
    """Failing references per table, column, reason and month, with the number of different keys.

    They come from the counts per key and month; references are looked at again only where part of a month is late.
    """
    failed = write_out(orphan_keys(refs, targets, most, least))
    whole = _reason(F.col("last"))
    counts = failed.withColumn("reason", whole).where(F.col("reason").isNotNull()).select("child_table", "ref_column", "reason", "period", "key", "n")
    part = _rows(refs, failed.where(whole.isNull()), most, least).groupBy("child_table", "ref_column", "reason", F.date_format("at", "yyyy-MM").alias("period"), "key").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(part).groupBy("child_table", "ref_column", "reason", "period").agg(F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_keys"))


def orphan_rows(refs: DataFrame, targets: DataFrame, most: int = HEAVY_KEYS, least: int = HEAVY_ROWS) -> DataFrame:
    """Each failing reference: child table and key, column, reason and the month its child was loaded.

    Keys are judged by ``orphan_keys``; only references to keys that failed are brought back. Null keys are no references; a
    child without load time gets a null period and is never late.
    """
    bad = _rows(refs, write_out(orphan_keys(refs, targets, most, least)), most, least)
    return bad.select("child_table", "child_key", "ref_column", "reason", F.date_format("at", "yyyy-MM").alias("period"))
