"""Mixing sources to target shares of the total size in tokens, by subset-sum budget fitting."""

from __future__ import annotations

import base64
import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quarrylight.llm.common import spread
from quarrylight.operators.skew import split_join
from quarrylight.scratch import write_out

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer's text is cut before its ranks apply.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The dynamic programme fits at most so many tokens of a source's budget; what is above is taken from all lengths alike.
WINDOW = 1 << 16
#: Documents of one length are ranked in so many buckets, each small even where a length is very common.
BUCKETS = 4096


def source_key(source: Column) -> Column:
    """A source's name as names are compared: trimmed, lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", "")), r"[ \-]", "_")


def token_counts(df: DataFrame, id_col: Column, source: Column, text: Column, tokenizer: str = TOKENIZER) -> DataFrame:
    """id, source (null if there is none), the tokens of each text under a public tokenizer (null texts have none) and a number of the row. Written once.

    ``tokenizer`` is a vocabulary file that every worker can open: a path on all machines, or the name of a file that
    ``SparkContext.addFile`` has sent there.
    """

    def run(batches):
        import tiktoken

        path = tokenizer if os.path.exists(tokenizer) else SparkFiles.get(os.path.basename(tokenizer))
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(coder.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("source"), pa.array(n, pa.int64())], ["id", "source", "n_tokens"])

    src = df.select(id_col.alias("id"), source_key(source).alias("source"), text.alias("text"))
    counted = spread(src).mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, source string, n_tokens bigint")
    return write_out(counted.withColumn("row", F.monotonically_increasing_id()))


def fit(lengths: np.ndarray, room: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many items of each length to take, at most ``room`` of each, so that their sizes come closest to ``budget`` from below.

    All lengths are thinned alike to a little less than the budget; a bounded knapsack fits the rest. Where it does not meet
    the budget exactly, it is given more of it, up to WINDOW; a budget within WINDOW is so met whenever any sum meets it.
    """
    total = int((lengths * room).sum())
    if budget >= total:
        return room.copy()
    order = np.random.default_rng(seed).permutation(len(lengths))
    spare, best, best_left = 4 * int(lengths.max()), None, budget + 1
    while True:
        spare = min(spare, WINDOW, budget)
        take = np.floor(room * ((budget - spare) / total)).astype(np.int64)
        left = budget - int((take * lengths).sum())
        while left > WINDOW:  # what rounding down left over
            before = left
            for i in order:
                if take[i] < room[i] and lengths[i] <= left - WINDOW // 2:
                    take[i] += 1
                    left -= int(lengths[i])
            if left == before:
                break
        take = take + _knapsack(lengths, room - take, left, order)
        left = budget - int((take * lengths).sum())
        if left < best_left:
            best, best_left = take, left
        if not left or spare >= min(WINDOW, budget):
            return best
        spare *= 4


def _knapsack(lengths: np.ndarray, spare: np.ndarray, budget: int, order: np.ndarray) -> np.ndarray:
    """Bounded knapsack over all sums up to ``budget``; numbers of items are cut into powers of two.

    Each sum remembers the first step that reached it, so memory is that of one row whatever the number of steps.
    """
    out = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return out
    first = np.full(budget + 1, -1, np.int32)
    first[0] = 0
    steps: list[tuple[int, int]] = [(0, 0)]
    for i in order:
        n, length, part = min(int(spare[i]), budget // max(1, int(lengths[i]))), int(lengths[i]), 1
        while n > 0 and length > 0 and first[budget] < 0:
            k = min(part, n)
            fresh = np.flatnonzero((first[: budget + 1 - k * length] >= 0) & (first[k * length :] < 0)) + k * length
            first[fresh] = len(steps)
            steps.append((i, k))
            n, part = n - k, part * 2
    at = int(np.flatnonzero(first >= 0)[-1])
    while at:
        i, k = steps[first[at]]
        out[i] += k
        at -= k * int(lengths[i])
    return out


def budgets(counts: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per target source: documents and tokens there are, its share among the sources that have any, and its budget.

    Without ``total`` the mixture is as large as it can be with every present source at its share. ``targets`` (source,
    target_share, max_repeats) has one row per source; sources without a target and targets without documents get no budget.
    """
    sizes = counts.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    t = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").join(sizes, "source", "left")
    t = t.withColumns({"n_docs": F.coalesce("n_docs", F.lit(0)), "n_tokens": F.coalesce("n_tokens", F.lit(0))})
    there = (F.col("n_tokens") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0)
    sums = t.where(there).agg(F.sum("target_share").alias("all"), F.min(F.col("n_tokens") * F.col("max_repeats") / F.col("target_share")).alias("most"))
    row = sums.first()  # one row
    if not row["all"]:
        return t.withColumns({"share": F.lit(0.0), "budget": F.lit(0).cast("bigint")})
    size = float(total) if total is not None else row["most"] * row["all"]
    share = F.when(there, F.col("target_share") / F.lit(row["all"])).otherwise(0.0)
    budget = F.least(F.floor(share * F.lit(size) + F.lit(0.5)), F.col("n_tokens") * F.col("max_repeats")).cast("bigint")
    return t.withColumn("share", share).withColumn("budget", budget)


def mix(counts: DataFrame, plan: DataFrame, seed: int = 1) -> DataFrame:
    """id, source, n_tokens and copies of each document in the mixture (copies > 0).

    ``counts`` is the result of ``token_counts``. Budgets are fitted over the numbers of copies of each exact length, up to
    ``max_repeats`` of every document: one small table per source whatever the number of documents. The copies of a length
    are spread over its documents, some having one more than others, which a seeded hash of their ids decides. Documents
    without tokens are left out; rows that repeat an id count as documents of their own.
    """
    key = F.concat_ws("|", "source", F.col("n_tokens").cast("string"))
    rows = counts.where((F.col("n_tokens") > 0) & F.col("source").isNotNull()).withColumn("key", key)
    wanted = plan.where(F.col("budget") > 0).select("source", "budget", "max_repeats")
    hist = rows.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")).join(wanted, "source")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens")
        n, most = pdf["n"].to_numpy(np.int64), int(pdf["max_repeats"].iloc[0])
        taken = fit(pdf["n_tokens"].to_numpy(np.int64), n * most, int(pdf["budget"].iloc[0]), seed)
        return pd.DataFrame({"key": pdf["source"] + "|" + pdf["n_tokens"].astype(str), "whole": taken // n, "more": taken % n})

    # one group holds as many rows as its source has different lengths
    chosen = write_out(hist.groupBy("source").applyInPandas(choose, "key string, whole bigint, more bigint").where("whole > 0 OR more > 0"))
    met = split_join(rows, chosen, "key", "inner").withColumn("place", F.xxhash64("id", F.lit(seed)))
    met = write_out(met.withColumn("bucket", F.pmod("place", F.lit(BUCKETS))))

    # the place up to which documents of a length get one copy more: its bucket, then its rank within that bucket
    partly = met.where("more > 0")
    filled = partly.groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("here"), F.any_value("more").alias("more"))
    before = F.coalesce(F.sum("here").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = filled.withColumn("before", before).where((F.col("before") < F.col("more")) & (F.col("before") + F.col("here") >= F.col("more")))
    edge = edge.select("key", "bucket", (F.col("more") - F.col("before")).cast("int").alias("rank"))
    spot = F.struct("place", "row")
    last = partly.join(edge, ["key", "bucket"]).groupBy("key", "bucket", "rank").agg(F.sort_array(F.collect_list(spot)).alias("spots"))
    last = write_out(last.select("key", F.col("bucket").alias("edge"), F.element_at("spots", F.col("rank")).alias("last")))
    placed = split_join(met, last, "key")
    extra = (F.col("bucket") < F.col("edge")) | (F.col("bucket") == F.col("edge")) & (spot <= F.col("last"))
    copies = F.col("whole") + F.when(extra, 1).otherwise(0)
    return placed.select("id", "source", "n_tokens", copies.cast("bigint").alias("copies")).where("copies > 0")


def report(plan: DataFrame, mixed: DataFrame) -> DataFrame:
    """Per source its target and actual share, budget and tokens, and how often its documents are used."""
    used = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_used"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"))
    total = used.agg(F.sum("mixed_tokens").alias("all_tokens"))
    rows = plan.join(used, "source", "left").join(F.broadcast(total))  # one row
    counts = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("n_used", "n_copies", "most_copies", "mixed_tokens")}
    rows = rows.withColumns(counts).withColumn("actual_share", F.coalesce(F.col("mixed_tokens") / F.col("all_tokens"), F.lit(0.0)))
    return rows.select("source", "target_share", F.col("share").alias("reachable_share"), "actual_share", "max_repeats", "most_copies", "n_docs", "n_used", "n_copies", "n_tokens", "budget", "mixed_tokens")
