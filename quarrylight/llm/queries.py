"""Queries p1 and p4 to p8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import leakage, main_content, mixing, near_duplicates, personal_data, splitting


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pipeline_row").select(F.lit("pipeline_row").alias("space"), F.col("row_id").alias("id"), "text")
    return rows.unionByName(table(spark, sf, "document_chunk").select(F.lit("document_chunk").alias("space"), F.col("chunk_id").alias("id"), F.col("content").alias("text")))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = near_duplicates.near_duplicate_pairs(p1_texts(spark, sf), F.col("space"), F.col("id"), F.col("text"), words=3, threshold=0.6, least=50)
    return pairs.withColumnRenamed("space", "table_name")


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    groups = near_duplicates.near_duplicate_groups(p1_texts(spark, sf), F.col("space"), F.col("id"), F.col("text"), words=3, threshold=0.6, least=50)
    return groups.withColumnRenamed("space", "table_name")


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf, "pipeline_row"), F.col("row_id"), F.col("text")).withColumnRenamed("id", "row_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_pieces(spark, sf).where(F.col("piece_no") == 1).select("row_id", "boundary")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    found = main_content.main_content(table(spark, sf, "page_export"), F.col("id"), F.col("link"), F.col("title"), F.col("content"))
    return found.withColumnRenamed("id", "page_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    found = leakage.leaks(table(spark, sf, "documents"), F.col("doc_id"), F.col("text"), table(spark, sf, "eval_item"))
    return found.where("verbatim").select(F.col("id").alias("doc_id"), "item_id").distinct()


def p6_leaked_items(spark: SparkSession, sf: str) -> DataFrame:
    found = leakage.leaks(table(spark, sf, "documents"), F.col("doc_id"), F.col("text"), table(spark, sf, "eval_item"), paraphrases=True)
    return found.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if("verbatim").alias("n_verbatim"), F.count_if("answered").alias("n_with_answer"), F.max("common").alias("most_common")
    )


def _mixture(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    counts = mixing.token_counts(table(spark, sf, "documents"), F.col("doc_id"), F.col("source"), F.col("text"))
    plan = mixing.budgets(counts, table(spark, sf, "mix_target"))
    return plan, mixing.mix(counts, plan)


def p7_mix_report(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.report(*_mixture(spark, sf))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf)[1].withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    found = personal_data.find_personal(table(spark, sf, "documents"), F.col("doc_id"), F.col("text"))
    return found.select(F.col("id").alias("doc_id"), "kind", "pii").distinct()


def p8_sanitized(spark: SparkSession, sf: str) -> DataFrame:
    return personal_data.sanitize(table(spark, sf, "documents"), F.col("doc_id"), F.col("text")).withColumnRenamed("id", "doc_id")


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p4_found": p4_found, "p4_pieces": p4_pieces, "p5_found": p5_found, "p6_found": p6_found, "p6_leaked_items": p6_leaked_items, "p7_mix": p7_mix, "p7_mix_report": p7_mix_report, "p8_found": p8_found, "p8_sanitized": p8_sanitized}

_FITS = "len(list_filter({}, lambda u: length(regexp_replace(u, '^\\s+|\\s+$', '', 'g')) > 2400)) = 0"
_LINES = "regexp_split_to_array(text, '\\r\\n|\\n|\\r')"
_SENTENCES = f"flatten(list_transform({_LINES}, lambda l: string_split(regexp_replace(regexp_replace(l, '([.!?])(\\s)', '\\1' || chr(1) || '\\2', 'g'), '([。！？])', '\\1' || chr(1), 'g'), chr(1))))"

SQL = {
    "p4_found": f"""
SELECT row_id, CASE
  WHEN {_FITS.format("list_transform(regexp_split_to_array(replace(text, chr(13) || chr(10), chr(2) || chr(10)), '(?:\\x02?\\n|\\r)(?:[ \\t]*(?:\\x02?\\n|\\r))+'), lambda u: replace(u, chr(2), ' '))")} THEN 'paragraph'
  WHEN {_FITS.format(_LINES)} THEN 'line'
  WHEN {_FITS.format(_SENTENCES)} THEN 'sentence'
  WHEN {_FITS.format("regexp_split_to_array(text, '\\s+')")} THEN 'word'
  ELSE 'char' END AS boundary
FROM pipeline_row WHERE length(text) > 2400""",
    "p6_found": """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\\p{L}\\p{N}]+') AS w FROM eval_item),
dg AS (SELECT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS u(k)),
ig AS (SELECT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM i, unnest(range(1, len(w) - 11)) AS u(k))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
