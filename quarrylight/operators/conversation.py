"""Conversations as rows (conversation, turn, role, text): trimming to a budget of tokens, headers, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import count_tokens
from quarrylight.operators.skew import split_join

BUDGET = 1024


def trim_history(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", budget: int = BUDGET, mode: str = "word") -> DataFrame:
    """Messages that fit the budget, with their tokens: everything if it fits, else all system messages and the longest run of
    the newest others; only the last system message if the system messages alone reach the budget.

    Turns must be unique within a conversation; null texts have no tokens, null roles are no system messages, rows without a
    conversation are left out. A conversation of a third of all rows is split: its totals are combined before the shuffle.
    """
    system = F.coalesce(F.col("role") == "system", F.lit(False))
    rows = messages.withColumn("tokens", count_tokens(F.col("text"), mode)).where(F.col(conv).isNotNull())
    totals = rows.groupBy(conv).agg(F.sum("tokens").alias("_all"), F.sum(F.when(system, F.col("tokens")).otherwise(0)).alias("_sys"), F.max(F.when(system, F.col(turn))).alias("_last"))
    # no more than ``budget`` messages with tokens can be kept: the newest of them are picked before the shuffle
    newest = Window.partitionBy(conv).orderBy(F.desc(turn))
    few = rows.where(~system & (F.col("tokens") > 0)).select(conv, turn, "tokens").withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= budget + 1)
    few = few.withColumn("_cum", F.sum("tokens").over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    over = few.join(totals.select(conv, "_sys"), conv).where(F.col("_cum") > budget - F.col("_sys")).groupBy(conv).agg(F.max(turn).alias("_over"))
    met = split_join(rows, totals.join(over, conv, "left"), conv, "inner")
    left = F.lit(budget) - F.col("_sys")
    fits = F.col("_over").isNull() | (F.col(turn) > F.col("_over"))
    keep = (F.col("_all") <= budget) | ((left > 0) & (system | fits)) | ((left <= 0) & (F.col(turn) == F.col("_last")))
    return met.where(keep).select(*messages.columns, "tokens")


def headers(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Per conversation its number of messages, first and last turn, and number of messages of users."""
    return messages.groupBy(conv).agg(F.count(F.lit(1)).alias("message_count"), F.min(turn).alias("first_turn"), F.max(turn).alias("last_turn"), F.count_if(F.col("role") == "user").alias("user_count"))


def summary(title: Column, n: Column, generated: Column | None = None) -> Column:
    """Below three messages the title or a notice; else what was generated, or the title."""
    named = F.coalesce(F.nullif(title, F.lit("")), F.lit("Empty conversation"))
    return F.when(n < 3, named).otherwise(F.coalesce(generated if generated is not None else F.lit(None).cast("string"), named))


def newest(df: DataFrame, by: str, key: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of a list, newest first; ties by key."""
    return df.orderBy(F.desc(by), key).offset(offset).limit(limit)


def to_json(role: Column, content: Column, at: Column) -> Column:
    return F.to_json(F.struct(role.alias("role"), content.alias("content"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")))


def from_json(c: Column) -> Column:
    """role, content and timestamp of a message; null for what cannot be read."""
    return F.from_json(c, "role string, content string, timestamp string")


def append(messages: DataFrame, new: DataFrame, conv: str = "conv_id", at: str = "created_at") -> DataFrame:
    """Messages with a whole-number ``turn``, and new ones (same columns without ``turn``) behind them: each gets the next turns of its conversation, by time.

    A conversation that is not there yet starts at turn 1. Rows without a conversation are left out of the new ones.
    """
    last = messages.groupBy(conv).agg(F.max("turn").alias("_last"))
    rows = split_join(new.where(F.col(conv).isNotNull()), last, conv)
    order = Window.partitionBy(conv).orderBy(at, "role", "text")
    turn = (F.coalesce("_last", F.lit(0)) + F.row_number().over(order)).cast(messages.schema["turn"].dataType)
    return messages.unionByName(rows.withColumn("turn", turn).select(*messages.columns))


def save(messages: DataFrame, folder: str, conv: str = "conv_id") -> None:
    """Add messages to a store of conversations; a conversation saved again replaces what was saved of it before (see ``load``)."""
    stamped = messages.withColumn("_saved", F.current_timestamp()).withColumn("_gone", F.lit(False))
    stamped.write.mode("append").parquet(folder)


def delete(spark: SparkSession, ids: DataFrame, folder: str, conv: str = "conv_id") -> None:
    """Delete conversations from a store: a row without messages outdates what was saved before."""
    schema = spark.read.parquet(folder).schema
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in (conv, "_saved", "_gone")]
    marks = ids.select(F.col(conv), *rest, F.current_timestamp().alias("_saved"), F.lit(True).alias("_gone"))
    marks.select(*schema.names).write.mode("append").parquet(folder)


def load(spark: SparkSession, folder: str, conv: str = "conv_id") -> DataFrame:
    """The conversations of a store as last saved, without those deleted since."""
    rows = spark.read.parquet(folder)
    newest_save = rows.groupBy(conv).agg(F.max("_saved").alias("_newest"))
    return split_join(rows, newest_save, conv, "inner").where((F.col("_saved") == F.col("_newest")) & ~F.col("_gone")).drop("_saved", "_gone", "_newest")
