"""Reading tables, documents and files."""

from __future__ import annotations

import io
import re
import sqlite3
import zipfile
from pathlib import Path
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarrylight.functions import html as H
from quarrylight.scratch import write_out

DOCUMENT_COLUMNS = ("link", "content")


def read_columns(spark: SparkSession, path: str, columns: list[str] | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """A Parquet file or folder, with some of its columns; an error names required columns that are missing."""
    df = spark.read.parquet(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return df.select(*columns) if columns else df


def read_all(spark: SparkSession, folder: str) -> DataFrame:
    """All Parquet files below a folder, columns that some lack being null there."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("mergeSchema", "true").parquet(folder)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Frames below each other by column name, missing columns as null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def document_rows(df: DataFrame, key: str = "id", text: str = "content", link: str = "link", lists: tuple[str, ...] = ("assets", "images")) -> DataFrame:
    """Rows as documents: id, text, metadata (all scalar columns that have a value, as strings) and assets (the first list there is)."""
    plain = [f.name for f in df.schema if f.name not in (text, *lists) and f.dataType.typeName() not in ("array", "map", "struct", "binary")]
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in plain]), lambda p: p["v"].isNotNull())
    have = [F.col(c) for c in lists if c in df.columns]
    assets = F.coalesce(*have, F.array().cast("array<string>")) if have else F.array().cast("array<string>")
    return df.select(F.coalesce(F.col(key).cast("string"), F.col(link)).alias("id"), F.col(text).alias("text"), F.map_from_entries(pairs).alias("metadata"), assets.alias("assets"))


def with_source(df: DataFrame) -> DataFrame:
    """A frame read from files with the ``source_path`` that each row comes from."""
    return df.select("*", F.col("_metadata.file_path").alias("source_path"))


def read_html(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """HTML files as documents (see ``html_documents``); a file that is no UTF-8 text becomes a row with its error."""
    files = spark.read.option("pathGlobFilter", "*.html").option("recursiveFileLookup", str(recursive).lower()).format("binaryFile").load(folder)
    text = F.col("content").cast("string")
    return html_documents(files.select("path", F.when(F.is_valid_utf8(text), text).alias("content")))


def html_documents(pages: DataFrame) -> DataFrame:
    """Pages (path, content) as path, text, metadata, assets, error.

    Metadata holds the named meta tags, over them the title, over them file_name, source and format. A null content, which
    could not be read, gives a notice as text, the file's name alone as metadata, and an error.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    bad = F.col("content").isNull()
    title = H.title(F.col("content"))
    known = F.create_map(F.lit("file_name"), name, F.lit("source"), F.col("path"), F.lit("format"), F.lit("html"))
    titled = F.when(title.isNotNull(), F.create_map(F.lit("title"), title)).otherwise(F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>")))
    own = F.map_filter(H.meta(F.col("content")), lambda k, _: ~k.isin("file_name", "source", "format") & ~((k == "title") & title.isNotNull()))
    notice = F.concat(F.lit("Error processing file: "), name)
    return pages.select(
        "path",
        F.when(bad, notice).otherwise(H.html_text(F.col("content"))).alias("text"),
        F.when(bad, F.create_map(F.lit("file_name"), name)).otherwise(F.map_concat(own, titled, known)).alias("metadata"),
        F.coalesce(H.images(F.col("content")), F.array().cast("array<string>")).alias("assets"),
        F.when(bad, "content is no readable text").alias("error"),
    )


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {text, metadata}; entries without a text are left out."""
    return spark.read.schema("text string, metadata map<string,string>").option("multiLine", "true").json(path).where("text IS NOT NULL")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Lines of {link, content}; empty and broken lines and empty contents are left out."""
    rows = spark.read.schema("link string, content string").option("mode", "DROPMALFORMED").json(path)
    return rows.where("content IS NOT NULL AND trim(content) <> ''")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """A CSV file with a header; strings unless a schema is given."""
    reader = spark.read.options(header="true", **options)
    return (reader.schema(schema) if schema else reader).csv(path)


def kind_of(source: str) -> str:
    """excel, csv or sqlite by the extension of a path, sql for a connection string."""
    if re.match(r"[a-z][\w+]*://|jdbc:", source):
        return "sql"
    kinds = {".xlsx": "excel", ".xlsb": "excel", ".xlsm": "excel", ".xls": "excel", ".csv": "csv", ".db": "sqlite", ".sqlite": "sqlite", ".sqlite3": "sqlite"}
    if (kind := kinds.get(Path(source).suffix.lower())) is None:
        raise ValueError(f"no reader for {source}")
    return kind


def chosen(names: list[str], include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """Names in their order, those included and not excluded."""
    return [n for n in names if (not include or n in include) and n not in (exclude or [])]


def sqlite_tables(path: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


class _Rows(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", 8))

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            try:
                low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
            except sqlite3.OperationalError:  # a table without row numbers is read in one piece
                return [_Rows(None, None)]
        if low is None:
            return [_Rows(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Rows(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            if partition.low is None:
                yield from db.execute(f'SELECT * FROM "{self.table}"')
                return
            yield from db.execute(f'SELECT * FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """A table of a SQLite file in a shared folder, read in ranges of its row numbers: format("sqlite_table"), options path, table, partitions."""

    @classmethod
    def name(cls):
        return "sqlite_table"

    def schema(self):
        kinds = {"INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double"}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            cols = db.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        return ", ".join(f"`{c[1]}` {kinds.get(c[2].upper(), 'string')}" for c in cols)

    def reader(self, schema):
        return _SqliteReader(self.options)


def read_sqlite(spark: SparkSession, path: str, include: list[str] | None = None, exclude: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of a SQLite file by name; empty ones are left out."""
    spark.dataSource.register(SqliteSource)
    out = {}
    for name in chosen(sqlite_tables(path), include, exclude):
        df = spark.read.format("sqlite_table").options(path=path, table=name).load()
        if df.limit(1).count():
            out[name] = df
    return out


def read_sql(spark: SparkSession, url: str, tables: list[str], include: list[str] | None = None, exclude: list[str] | None = None, **options) -> dict[str, DataFrame]:
    """Tables behind a JDBC address; partitionColumn and its bounds may be given as options."""
    return {t: spark.read.format("jdbc").options(url=url, dbtable=t, **options).load() for t in chosen(tables, include, exclude)}


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column_number(ref: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _sheet_rows(content: bytes):
    """Rows of all sheets of a workbook, parsed as they are read: sheet, its place, row number, cells as text."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            for _, item in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
                if item.tag == _MAIN + "si":
                    shared.append("".join(t.text or "" for t in item.iter(_MAIN + "t")))
                    item.clear()
        files = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for place, sheet in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_MAIN + "sheet")):
            target = files[sheet.get(_REL)]
            for _, row in ElementTree.iterparse(book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}")):
                if row.tag != _MAIN + "row":
                    continue
                cells: list[str | None] = []
                for cell in row.iter(_MAIN + "c"):
                    at = _column_number(cell.get("r", "")) if cell.get("r") else len(cells)
                    value = cell.find(_MAIN + "v")
                    text = None if value is None else value.text
                    if cell.get("t") == "s" and text is not None:
                        text = shared[int(text)]
                    elif cell.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(_MAIN + "t"))
                    elif cell.get("t") == "b" and text is not None:
                        text = "True" if text == "1" else "False"
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = text
                yield sheet.get("name"), place, int(row.get("r", 0)), cells
                row.clear()


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all sheets of the .xlsx workbooks at a path or pattern: path, sheet, place, row_no, cells; read by the tasks, a workbook (bounded by its format) in each.

    A file that is no workbook gives no rows.
    """

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                try:
                    for row in _sheet_rows(content):
                        rows.append((name, *row))
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows = []
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    pass
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.repartition("path").mapInArrow(run, "path string, sheet string, place int, row_no bigint, cells array<string>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "sheet", "place", "row_no", "cells"])


def read_excel(spark: SparkSession, path: str, include: list[str] | None = None, exclude: list[str] | None = None, header: dict[str, int] | int = 0) -> dict[str, DataFrame]:
    """The sheets of a workbook by name, as strings; empty sheets are left out.

    Only the header rows, one a sheet, come to the driver; ``header`` is the row, counted from 0, that holds a sheet's names.
    """
    rows = write_out(workbook_rows(spark, path))
    names = [r["sheet"] for r in rows.groupBy("sheet").agg(F.min("place").alias("p")).orderBy("p").collect()]
    out = {}
    for name in chosen(names, include, exclude):
        at = header.get(name, 0) if isinstance(header, dict) else header
        own = rows.where(F.col("sheet") == name)
        head = own.where(F.col("row_no") == at + 1).select("cells").first()
        body = own.where(F.col("row_no") > at + 1)
        if head is None or not body.limit(1).count():
            continue
        titles = [str(c or f"column_{i}") for i, c in enumerate(head["cells"])]
        out[name] = body.orderBy("row_no").select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(titles)])
    return out


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files below a folder with size and time, without reading them: path, name, extension, length, modified."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return f.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("extension"), "length", F.col("modificationTime").alias("modified"))


def find_file(files: DataFrame, part: str) -> DataFrame:
    """Of ``list_files`` the first by path whose name contains ``part``; no row if there is none."""
    return files.where(F.col("name").contains(part)).orderBy("path").limit(1)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files whole: path and text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def sample(df: DataFrame, n: int = 5) -> dict:
    """Columns, types and the first rows of a table, for people."""
    return {"columns": df.columns, "types": dict(df.dtypes), "rows": [r.asDict() for r in df.limit(n).collect()]}
