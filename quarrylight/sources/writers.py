"""Writing documents, indexes and logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.operators import vectors
from quarrylight.operators.chunking import word_chunks

# fixed values: extensions of common kinds of content
EXTENSIONS = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "application/pdf": ".pdf", "text/html": ".html", "text/plain": ".txt"}


def limited(df: DataFrame, limit: int | None, key: str) -> DataFrame:
    """The first rows by key if a positive limit is given, else all."""
    return df.orderBy(key).limit(limit) if isinstance(limit, int) and limit > 0 else df


def write_pages(df: DataFrame, folder: str, name: str = "file_name", html: str = "html") -> None:
    """One file per row, written by the tasks below an address that pyarrow can open (file, hdfs, s3 and others).

    A file of the same name is replaced, so a task may run again.
    """

    def run(rows):
        from pyarrow import fs

        store, to = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(to, recursive=True)
        for r in rows:
            with store.open_output_stream(f"{to}/{r[name].replace('/', '_')}") as f:
                f.write((r[html] or "").encode())

    df.select(name, html).foreachPartition(run)


def copy_assets(df: DataFrame, source: str = "source", target: str = "target") -> None:
    """Copy files that are not there yet, each pair once; both are addresses that pyarrow can open, or paths."""

    def run(rows):
        from pyarrow import fs

        for r in rows:
            (a, path), (b, to) = (fs.FileSystem.from_uri(x if "://" in x else f"file://{x}") for x in (r[source], r[target]))
            if b.get_file_info(to).type == fs.FileType.NotFound and a.get_file_info(path).type == fs.FileType.File:
                b.create_dir(to.rsplit("/", 1)[0], recursive=True)
                with a.open_input_stream(path) as src, b.open_output_stream(to) as out:
                    while part := src.read(1 << 20):
                        out.write(part)

    df.select(source, target).dropDuplicates().foreachPartition(run)


def safe_filename(name: Column, key: Column, mime: Column) -> Column:
    """The name, else the id; with the extension of its kind where it has none."""
    ext = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), mime), F.lit(".bin"))
    base = F.coalesce(F.nullif(name, F.lit("")), key.cast("string"))
    return F.when(base.contains("."), base).otherwise(F.concat(base, ext))


def append_index(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Vectors with their metadata, in one row each."""
    df.write.mode("overwrite" if overwrite else "append").parquet(path)


def build_index(df: DataFrame, path: str, text: str = "text", size: int = 800, overlap: int = 100, provider=vectors.hashing_provider) -> None:
    """Chunks of documents with their embeddings added to the index at ``path``: those of a text that is not there yet, each once.

    The hash of a chunk's text is its key, so a run that is repeated or goes on after a failure adds nothing twice.
    """
    chunks = word_chunks(df, text, size, overlap).drop(text).withColumn("sha", F.sha2("chunk", 256))
    try:
        known = df.sparkSession.read.parquet(path).select("sha")
    except AnalysisException:  # no index yet
        known = chunks.select("sha").limit(0)
    append_index(vectors.with_embedding(vectors.unseen(chunks, known, "sha"), "chunk", provider), path)


def write_log(df: DataFrame, path: str, at: str = "ts", kind: str = "event_type") -> None:
    """Events as JSON lines by kind and day."""
    df.withColumn("day", F.date_format(at, "yyyy-MM-dd")).write.mode("append").partitionBy(kind, "day").json(path)


def answer_table(df: DataFrame, question: str = "question", answer: str = "answer", source: str = "source") -> DataFrame:
    """One row per question with its answer and its sources joined."""
    return df.groupBy(question).agg(F.min(answer).alias(answer), F.array_join(F.array_sort(F.collect_set(source)), ", ").alias("sources"))
