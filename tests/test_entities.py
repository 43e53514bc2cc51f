import json
import sqlite3
import zipfile
from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import metadata as M
from quarrylight.operators import relational as R
from quarrylight.plans import entities
from quarrylight.sources import readers, writers
from quarrylight.streaming import incremental


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_names():
    assert R.clean_column("<Id>") == "Id" and R.clean_column("Guide|Name") == "Name"
    assert R.entity_of("steps 2024", {"guide": "g", "regex:^steps": "step"}) == "step" and R.entity_of("other", {}) == "other"
    assert R.roots(["a", "b"], [R.Relationship("a", "b", "id", "a_id")]) == ["a"] and R.roots(["a"], [R.Relationship("b", "a", "", "")]) == ["a"]


def test_nest(spark):
    parents = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "id long, children string")
    children = spark.createDataFrame([(10, 1), (11, 1), (12, None)], "c long, p long")
    got = {r["id"]: r["kids"] for r in R.nest(parents, children, "id", "p", F.col("c"), "kids").collect()}
    assert got == {1: [10, 11], 2: [], None: None}


def test_templates(spark):
    df = spark.createDataFrame([("", "b"), ("nan", None), ("v", "w")], "a string, b string")
    got = [r[0] for r in df.select(R.template_text("{a|none}-{b}{c|!}", df.columns)).collect()]
    assert got == ["none-b!", "none-!", "v-w!"]
    assert R.clean_columns(df.toDF("x|a", "<a>")).columns == ["a", "a_2"]


def test_assets(spark):
    df = spark.createDataFrame([("p.png", "", '{"path": "q.pdf"}', None)], "image_file string, doc_path string, cell string, other string")
    assert df.select(R.assets(df.columns)).first()[0] == ["p.png"]
    assert df.select(R.json_asset(F.col("cell"))).first()[0] == "q.pdf"


def test_metadata(spark):
    df = spark.createDataFrame([("t", "x1", "EN"), (None, "5", None)], "title string, n string, lang string")
    schema = [M.Field("title", required=True), M.Field("n", "integer"), M.Field("lang", pattern=M.LANGUAGE)]
    got = [r[0] for r in df.select(M.problems({c: F.col(c) for c in df.columns}, schema)).collect()]
    assert got == [["n: not a integer", "lang: pattern"], ["title: missing"]]
    assert [value(spark, M.relevance(F.lit(s))) for s in (0.5, 0.4, 0.3, 0.2)] == ["high", "medium", "medium", "low"]
    assert value(spark, M.merge(F.lit("y"), F.lit("x"))) == "y"
    assert set(M.CANONICAL) <= set(M.canonical(df).columns)


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,b\n")
    assert readers.read_csv(spark, str(tmp_path / "a.csv"), "x long, y string").first()["x"] == 1
    (tmp_path / "a.jsonl").write_text('{"link": "a", "content": "b"}\n\nbroken\n{"link": "c", "content": " "}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "a.jsonl")).count() == 1
    (tmp_path / "d.json").write_text('[{"text": "a", "metadata": {"k": "v"}}, {"metadata": {}}]')
    assert readers.read_json_documents(spark, str(tmp_path / "d.json")).count() == 1
    (tmp_path / "h").mkdir()
    (tmp_path / "h/p.html").write_text("<p>é</p>")
    (tmp_path / "h/q.html").write_text('<title>T &rarr;</title><meta name="author" content="A &amp; B &#8211; C"><meta name="title" content="other"><p>1 &lt; 2 &euro; &#x3c;b&#62;</p>')
    (tmp_path / "h/r.html").write_bytes(b"<p>\xff\xfe</p>")
    p, q, r = readers.read_html(spark, str(tmp_path / "h")).orderBy("path").collect()
    assert p["text"] == "é" and p["error"] is None and p["metadata"]["file_name"] == "p.html" and p["metadata"]["format"] == "html"
    assert q["text"] == "T → 1 < 2 € <b>" and q["metadata"]["author"] == "A & B – C" and q["metadata"]["title"] == "T &rarr;"
    assert r["error"] and r["text"] == "Error processing file: r.html" and r["metadata"] == {"file_name": "r.html"}
    assert {x["name"] for x in readers.list_files(spark, str(tmp_path / "h")).collect()} == {"p.html", "q.html", "r.html"}
    with pytest.raises(ValueError):
        spark.range(1).write.parquet(str(tmp_path / "q"))
        readers.read_columns(spark, str(tmp_path / "q"), required=("link",))
    assert [readers.kind_of(s) for s in ("a.xlsx", "b.csv", "c.db", "jdbc:x")] == ["excel", "csv", "sqlite", "sql"]


def workbook(path, sheets):
    """A small workbook: sheets of rows of text, numbers and nothing."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared, files = [], {}
    for k, rows in enumerate(sheets.values(), 1):
        out = []
        for n, row in enumerate(rows, 1):
            cells = []
            for c, v in enumerate(row):
                ref = f"{chr(65 + c)}{n}"
                if isinstance(v, str):
                    cells.append(f'<c r="{ref}" t="s"><v>{len(shared)}</v></c>')
                    shared.append(v)
                elif v is not None:
                    cells.append(f'<c r="{ref}"><v>{v}</v></c>')
            out.append(f'<row r="{n}">{"".join(cells)}</row>')
        files[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="{main}"><sheetData>{"".join(out)}</sheetData></worksheet>'
    files["xl/workbook.xml"] = f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>"
    files["xl/_rels/workbook.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>"
    files["xl/sharedStrings.xml"] = f'<sst xmlns="{main}">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>"
    with zipfile.ZipFile(path, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"guide": [["Id", "Name"], [1, "x"], [2, None], [None, "z"]], "note": [["top"], ["Id", None, "T"], [7, "b", "c"]], "empty": [["Id"]]})
    got = readers.read_excel(spark, str(tmp_path / "a.xlsx"), header={"note": 1})
    assert list(got) == ["guide", "note"]
    assert [tuple(r) for r in got["guide"].collect()] == [("1", "x"), ("2", None), (None, "z")]
    assert [r.asDict() for r in got["note"].collect()] == [{"Id": "7", "column_1": "b", "T": "c"}]
    assert list(readers.read_excel(spark, str(tmp_path / "a.xlsx"), exclude=["guide"])) == ["note"]
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    assert {r["path"].rsplit("/")[-1] for r in readers.workbook_rows(spark, str(tmp_path / "*.xlsx")).collect()} == {"a.xlsx"}


def test_all_files_below_a_folder(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id long, x string").write.parquet(str(tmp_path / "p/one"))
    spark.createDataFrame([(2, True)], "id long, y boolean").write.parquet(str(tmp_path / "p/deep/two"))
    got = readers.with_source(readers.read_all(spark, str(tmp_path / "p")))
    assert {(r["id"], r["x"], r["y"]) for r in got.collect()} == {(1, "a", None), (2, None, True)}
    assert all("/one/" in r["source_path"] or "/two/" in r["source_path"] for r in got.collect())


def test_assembled_entities(spark):
    parents = spark.createDataFrame([(1, "a", "f.png"), (2, None, None), (None, "n", None)], "id long, name string, file string")
    kids = spark.createDataFrame([(10, 1, "x"), (11, 1, "y"), (11, 2, "y"), (12, None, "z"), (13, 9, "w")], "kid long, up long, v string")
    made = R.assemble("guide", "book", parents, "id", F.col("name"), {"step": (kids, R.Relationship("guide", "step", "id", "up"), "kid"), "none": (kids.limit(0), R.Relationship("guide", "none", "id", "up"), "kid")}, ("name",), R.assets(["file"]))
    got = {json.loads(r["structured"])["entity"].get("id"): r for r in made.collect()}
    one, two, none = (json.loads(got[k]["structured"])["relationships"] for k in (1, 2, None))
    assert [(x["id"], x["data"]["v"]) for x in one["step"]["data"]] == [(10, "x"), (11, "y")] and one["step"]["type"] == "one_to_many" and one["none"]["data"] == []
    assert two["step"]["data"] == [] and none == {}
    assert got[1]["metadata"] == {"source": "book", "source_type": "relational_data", "entity_name": "guide", "entity_id": "1", "name": "a"} and "name" not in got[2]["metadata"]
    assert got[1]["assets"] == ["f.png"] and got[2]["assets"] == [] and got[1]["id"] == "relational_book_guide_1"


def test_metadata_rules(spark):
    from quarrylight.operators import metadata as M

    rules = [M.MapField("a", "b"), M.CombineFields(("a", "none", "b"), "ab", "-"), M.ExtractJson("j", "x", "p.q"), M.MapField("none", "a")]
    df = spark.createDataFrame([(1, {"a": "1", "b": "old", "j": '{"p": {"q": "deep"}}'}), (2, {"a": "", "j": "{broken"}), (3, None)], "id long, m map<string,string>")
    got = {r["id"]: r["m"] for r in df.select("id", M.apply_rules(F.col("m"), rules).alias("m")).collect()}
    assert got[1] == {"a": "1", "b": "1", "j": '{"p": {"q": "deep"}}', "ab": "1-1", "x": "deep"} and got[2] == {"a": "", "b": "", "j": "{broken"} and got[3] is None
    both = M.extract_schemas([{"t": [F.lit(None).cast("string")]}, {"t": [F.lit("x")], "u": [F.lit("y")]}])
    assert tuple(spark.range(1).select(*both.values()).first()) == ("x", "y") and list(both) == ["t", "u"]


def test_tables_as_text(spark):
    from quarrylight.operators import metadata as M

    df = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "id long, v string")
    text = M.table_text(df.orderBy("id"), "s", most_rows=2)
    assert text.startswith("Sheet: s\nColumns: id, v\nRows: 5\n\n") and text.endswith("[Note: Showing first 2 rows out of 5 total rows]") and "v1" in text and "v2" not in text
    assert M.table_text(df.limit(0)) == "Sheet 'Unknown' is empty."


def test_files(spark, tmp_path):
    for name in ("b-77.txt", "a-77.txt", "c.txt"):
        (tmp_path / name).write_text(f"in {name}\nmore")
    files = readers.list_files(spark, str(tmp_path))
    assert [r["name"] for r in readers.find_file(files, "77").collect()] == ["a-77.txt"] and readers.find_file(files, "99").count() == 0
    assert {r["text"] for r in readers.read_texts(spark, str(tmp_path)).collect()} == {f"in {n}\nmore" for n in ("a-77.txt", "b-77.txt", "c.txt")}


def test_sqlite_without_row_numbers(spark, tmp_path):
    path = str(tmp_path / "w.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (a TEXT PRIMARY KEY, b REAL) WITHOUT ROWID")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(f"k{i}", i / 2) for i in range(9)])
    assert readers.read_sqlite(spark, path)["t"].agg(F.sum("b")).first()[0] == 18.0


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (a INTEGER, b TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(i, f"v{i}") for i in range(50)])
        db.execute("CREATE TABLE empty (a INTEGER)")
    got = readers.read_sqlite(spark, path)
    assert list(got) == ["t"] and got["t"].agg(F.sum("a")).first()[0] == 1225 and got["t"].count() == 50


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("0001.html", "<p>a</p>"), ("0002.html", None)], "file_name string, html string")
    writers.write_pages(df, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["0001.html", "0002.html"]
    writers.write_log(spark.createDataFrame([(D(2024, 1, 1), "click")], "ts timestamp, event_type string"), str(tmp_path / "log"))
    assert (tmp_path / "log/event_type=click/day=2024-01-01").exists()
    (tmp_path / "s.txt").write_text("x")
    writers.copy_assets(spark.createDataFrame([(str(tmp_path / "s.txt"), str(tmp_path / "n/t.txt"))] * 2, "source string, target string"))
    assert (tmp_path / "n/t.txt").read_text() == "x"
    assert writers.limited(df, 1, "file_name").count() == 1 and writers.limited(df, 0, "file_name").count() == 2


def test_index_stream(spark, tmp_path):
    schema = "doc_id long, text string, loaded_at timestamp"
    for k, rows in enumerate(([(1, "a b c", D(2024, 1, 1)), (2, "a b c", D(2024, 1, 2))], [(3, "d e", D(2024, 1, 3)), (4, None, D(2024, 1, 3))])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        incremental.index_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 2, 0).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["chunk"] for r in got.collect()) == ["a b", "c", "d e"]


def test_windows_open_at_the_end_come_out(spark, tmp_path):
    rows = [(D(2024, 1, 1, h, m), kind, 1.5) for h in (9, 10, 11) for m in (0, 50) for kind in ("a", "b")]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "e.parquet"))
    part = next((tmp_path / "e.parquet").glob("part-*.parquet"))
    (tmp_path / "in").mkdir()
    part.rename(tmp_path / "in" / "events.parquet")
    got = sorted((r["start"], r["event_type"], r["n"], r["total"]) for r in entities.QUERIES["streamed_windows"](spark, str(tmp_path / "in")).collect())
    assert [(t.hour, kind, n, total) for t, kind, n, total in got] == [(h, kind, 2, 3.0) for h in (9, 10, 11) for kind in ("a", "b")]


def test_sections_of_any_content(spark, tmp_path):
    contents = ['{"text": "a \\"b\\""}', '{"text": "c", "more": 1}', '{"image": {"name": "x.png"}, "alt": "y"}', '{"image": {"name": "q\\"r.png"}}', '{"image": ', "plain", None]
    rows = [(i, 1, None, c, D(2024, 1, 1)) for i, c in enumerate(contents)]
    spark.createDataFrame(rows, "id long, stepid long, parentsectionid long, content string, loaded_at timestamp").write.parquet(str(tmp_path / "guidestepsection.parquet"))
    assets = {tuple(r) for r in entities.QUERIES["section_assets_whole"](spark, str(tmp_path)).collect()}
    assert assets == {(2, "x.png"), (3, 'q"r.png')}
    texts = {r["id"]: r["text"].split("\n\n")[1] for r in entities.QUERIES["entity_texts_whole"](spark, str(tmp_path)).collect()}
    assert texts == {0: 'a "b"', 1: "c", 2: contents[2], 3: contents[3], 4: '{"image": ', 5: "plain", 6: "## Details"}
