"""Exact vector search. The query set goes in blocks against all of the corpus, which stays where it was read.

Tasks pack their corpus vectors into blocks without a shuffle; each pair of a corpus block and a query block is one matrix
product, of which only the best ``k`` per query go on. Null vectors are left out; a zero vector has no cosine and comes
last; ties go to the smaller id.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from quarrylight.scratch import write_out

BLOCK = 4096
_WORD = re.compile(r"[^\W_]+")


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"))


def _packed(batches):
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK):
            part = b.slice(lo, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([part.column(1).flatten().to_numpy(zero_copy_only=False)], pa.list_(pa.float32()))], ["c_ids", "c_vals"])


def _search(metric: str, k: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                q_ids, c_ids = (np.asarray(b.column(c)[i].values) for c in ("q_ids", "c_ids"))
                q, c = (np.asarray(b.column(n)[i].values, dtype=np.float64).reshape(len(ids), -1) for n, ids in (("q_vals", q_ids), ("c_vals", c_ids)))
                if metric == "l2":
                    sim = -((q**2).sum(1)[:, None] - 2 * q @ c.T + (c**2).sum(1)[None, :])
                else:
                    sim = q @ c.T
                    if metric == "cosine":
                        with np.errstate(divide="ignore", invalid="ignore"):
                            sim = sim / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(c, axis=1)[None, :]
                low = np.where(np.isnan(sim), -np.inf, np.round(sim, 9))
                kth = np.partition(low, -k, axis=1)[:, -k] if k < low.shape[1] else np.full(len(low), -np.inf)
                row, col = np.nonzero(low >= kth[:, None])  # the best k of each query, with all that tie with the last
                order = np.lexsort((c_ids[col], -low[row, col], row))
                row, col = row[order], col[order]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[nth < k], col[nth < k]
                best = low[row, col]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(c_ids[col]), pa.array(best, mask=np.isinf(best))], ["query_id", "id", "score"])

    return run


def top_k(corpus: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, metric: str = "cosine") -> DataFrame:
    """query_id, rank (from 1), id and raw score of the ``k`` nearest of all corpus rows to each query; fewer if there are fewer.

    ``metric`` is cosine, ip (also dot, inner_product) or l2 (also euclidean), for which the score is the squared distance,
    smallest first. Keys must be unique. Query blocks are broadcast where the planner finds them small enough; else corpus
    blocks are sent to them, spread over so many tasks as there are cores.
    """
    metric = {"dot": "ip", "inner_product": "ip", "euclidean": "l2"}.get(metric, metric)
    if metric not in ("cosine", "ip", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    asked = write_out(_vectors(queries, key, vector))
    n = max(1, -(-asked.count() // BLOCK))
    spread = max(1, corpus.sparkSession.sparkContext.defaultParallelism // n)
    q = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("q_block")).agg(F.collect_list(F.struct("id", "v")).alias("x"))
    q = write_out(q.select("q_block", F.col("x.id").alias("q_ids"), F.flatten("x.v").alias("q_vals")))
    q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    c = _vectors(corpus, key, vector).mapInArrow(_packed, "c_ids array<bigint>, c_vals array<float>")
    c = c.withColumn("salt", F.pmod(F.hash(F.get("c_ids", F.lit(0))), F.lit(spread))).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    found = c.join(q, ["q_block", "salt"]).select("q_ids", "q_vals", "c_ids", "c_vals").mapInArrow(_search(metric, k), "query_id bigint, id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "id"))
    score = F.round(-F.col("score") if metric == "l2" else F.col("score"), 6)
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", score.alias("score"))


def compatible_score(raw: Column) -> Column:
    """1 - raw / 2 for raw scores up to 2, else 0: a distance reading kept beside the sound one."""
    return F.when(raw <= 2, 1 - raw / 2).otherwise(0.0)


def above(hits: DataFrame, threshold: float) -> DataFrame:
    """Hits whose score reaches a threshold."""
    return hits.where(F.col("score") >= threshold)


def best_per_source(hits: DataFrame, query: str, rank: str, *names: Column) -> DataFrame:
    """Of the hits of a query that share a source (the first of ``names`` that is not empty) the best ranked; hits without any count as one source."""
    source = F.coalesce(*[F.nullif(n.cast("string"), F.lit("")) for n in names])
    return hits.withColumn("_s", source).withColumn("_k", F.row_number().over(Window.partitionBy(query, "_s").orderBy(rank))).where(F.col("_k") == 1).drop("_s", "_k")


def route(domain: Column, override: Column | None, known: list[str], default: str = "default") -> Column:
    """The index to ask: the override, else the domain's own, else the default."""
    own = F.when(domain.isin(known), domain).otherwise(default)
    return own if override is None else F.coalesce(F.nullif(override, F.lit("")), own)


def hashing_provider(texts: list[str], dim: int = 64) -> np.ndarray:
    """The offline embedding: signed counts of hashed words, of length 1; the zero vector for a text without words."""
    out = np.zeros((len(texts), dim), np.float32)
    for row, text in zip(out, texts, strict=True):
        codes = np.fromiter((crc32(w.encode()) for w in _WORD.findall(text.lower())), np.int64)
        np.add.at(row, codes % dim, np.where(codes // dim % 2 == 0, 1.0, -1.0))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def with_embedding(df: DataFrame, text: str, provider=hashing_provider) -> DataFrame:
    """Rows with the embedding of their text, batch by batch; ``provider`` turns texts into rows of a matrix inside the tasks. Null texts count as empty."""
    kept = df.drop("embedding")

    def run(batches):
        for b in batches:
            got = pa.array(list(np.asarray(provider([t or "" for t in b.column(text).to_pylist()]), np.float32)), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*b.columns, got], [*b.schema.names, "embedding"])

    schema = StructType([*kept.schema.fields, StructField("embedding", ArrayType(FloatType()))])
    return kept.mapInArrow(run, schema)


def embed(df: DataFrame, key: str, text: str, provider=hashing_provider) -> DataFrame:
    """vec_id and embedding of each row's text."""
    return with_embedding(df.select(F.col(key).cast("bigint").alias("vec_id"), F.col(text).alias("_t")), "_t", provider).drop("_t")


def identity(id_col: Column, meta_id: Column, source: Column, text: Column) -> Column:
    """What a document is recognized by: its id, the id or source in its metadata, else a hash of its text."""
    return F.coalesce(id_col.cast("string"), meta_id.cast("string"), source.cast("string"), F.sha2(text, 256))


def unseen(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """New rows whose key is not known yet, one per key (any of equal ones); rows without a key are kept out."""
    once = new.where(F.col(key).isNotNull()).dropDuplicates([key])
    return once.join(known.select(key), key, "left_anti")


def retrieved(hits: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Hits with the documents they stand for (columns of ``documents`` but its ``key``); a hit without a document keeps nulls, one of a null key has none."""
    return hits.join(documents.withColumnRenamed(key, "id"), "id", "left")


def nearest_label(df: DataFrame, key: str, vector: str, labels: DataFrame) -> DataFrame:
    """The label whose vector is nearest by cosine: key, label, score. ``labels`` (label, vector) is small configuration, one row a label.

    Ties go to the smaller label; a zero vector has none.
    """
    known = labels.select(F.row_number().over(Window.orderBy("label")).cast("bigint").alias("_l"), "label", F.col("vector").alias(vector))
    best = top_k(known, df.select(F.col(key).alias("_l"), vector), "_l", vector, k=1).where(F.col("score").isNotNull())
    return best.join(known.select(F.col("_l").alias("id"), "label"), "id").select(F.col("query_id").alias(key), "label", "score")
