"""Cutting texts into chunks. Each function keeps the columns of its input and adds chunk_index (from 0) and the chunk.

A column of the input that is called like a new one gives way to it. Rows whose text is null, empty or white space give no chunks; repeated rows are cut again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T

SIZE, OVERLAP = 800, 100


def _others(df: DataFrame, *new: str) -> list[str]:
    return [c for c in df.columns if c not in new]


def _windows(df: DataFrame, items: Column, size: int, overlap: int) -> DataFrame:
    if not 0 <= overlap < size:
        raise ValueError(f"the overlap must be at least 0 and below the size, not {overlap} and {size}")
    starts = F.transform(F.sequence(F.lit(0), F.size("_items") - 1, F.lit(size - overlap)), lambda s: s)
    rows = df.withColumn("_items", items).where(F.size("_items") > 0)
    return rows.select("*", F.posexplode(starts).alias("chunk_index", "_start"))


def word_chunks(df: DataFrame, column: str = "text", size: int = SIZE, overlap: int = OVERLAP, out: str = "chunk") -> DataFrame:
    """Sliding windows of words, the last one kept even if the one before holds it: chunk, token_count, start_word_idx, end_word_idx (exclusive)."""
    rows = _windows(df.drop("chunk_index"), T.words(F.col(column)), size, overlap)
    part = F.slice("_items", F.col("_start") + 1, size)
    return rows.select(*_others(df, "chunk_index", out, "token_count", "start_word_idx", "end_word_idx"), "chunk_index", F.array_join(part, " ").alias(out), F.size(part).alias("token_count"), F.col("_start").alias("start_word_idx"), (F.col("_start") + F.size(part)).alias("end_word_idx"))


def token_windows(df: DataFrame, column: str = "text", size: int = SIZE, overlap: int = OVERLAP, out: str = "chunk") -> DataFrame:
    """Windows of word and punctuation tokens joined by blanks, ending with the window that reaches the end; a short text stays as it is, trimmed."""
    rows = _windows(df.drop("chunk_index"), T.tokens(F.col(column)), size, overlap)
    last = F.greatest(F.ceil((F.size("_items") - size) / (size - overlap)), F.lit(0))
    part = F.array_join(F.slice("_items", F.col("_start") + 1, size), " ")
    whole = F.size("_items") <= size
    return rows.where(F.col("chunk_index") <= last).select(*_others(df, "chunk_index", out), "chunk_index", F.when(whole, T.strip(F.col(column))).otherwise(part).alias(out))


def header_chunks(df: DataFrame, column: str = "text", size: int = SIZE, overlap: int = OVERLAP, out: str = "chunk") -> DataFrame:
    """Markdown cut at headings of rank 1, each heading a chunk of its own; a text without any is cut into windows of words."""
    has = F.col(column).rlike(r"(?dm)^# .+$")
    marked = F.regexp_replace(F.col(column), r"(?dm)^(# .+)$", "\u0001$1\u0001")
    parts = F.filter(F.transform(F.split(marked, "\u0001"), T.strip), lambda p: p != "")
    headed = df.where(has).select(*_others(df, "chunk_index", out), F.posexplode(parts).alias("chunk_index", out))
    plain = word_chunks(df.where(~has), column, size, overlap, out).select(*_others(df, "chunk_index", out), "chunk_index", out)
    return headed.unionByName(plain)


def typed_chunks(df: DataFrame, column: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows of words with the kind of text they were cut from: chunk_type and the columns of ``word_chunks``."""
    return word_chunks(df.withColumn("chunk_type", T.content_type(F.col(column))), column, size, overlap)


def html_sections(df: DataFrame, column: str = "content", out: str = "chunk") -> DataFrame:
    """HTML cut before headings of rank 1 to 3 and around figures: chunk_index, chunk_type (figure, section or lead), heading, and the part as it stands.

    Parts of white space alone are left out.
    """
    marked = F.regexp_replace(F.regexp_replace(F.col(column), r"(?i)(<h[1-3]\b)", "\u0001$1"), r"(?is)(<figure\b.*?</figure\s*>)", "\u0001$1\u0001")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: T.strip(p) != "")
    rows = df.select(*_others(df, "chunk_index", "chunk_type", "heading", out), F.posexplode(parts).alias("chunk_index", out))
    kind = F.when(F.col(out).rlike(r"(?i)^<figure\b"), "figure").when(F.col(out).rlike(r"(?i)^<h[1-3]\b"), "section").otherwise("lead")
    heading = F.when(kind == "section", F.nullif(F.regexp_extract(out, r"(?is)^<h[1-3]\b[^>]*>([^<]*)", 1), F.lit("")))
    return rows.select(*_others(df, "chunk_index", "chunk_type", "heading", out), "chunk_index", kind.alias("chunk_type"), heading.alias("heading"), out)


STRATEGIES = {"none": word_chunks, "header": header_chunks}


def chunk(df: DataFrame, strategy: str = "none", **options) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](df, **options)
