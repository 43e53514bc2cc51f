"""Queries on related tables, metadata, sources and streams."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import metadata as M
from quarrylight.operators import relational as R
from quarrylight.plans.relations import table
from quarrylight.sources import readers, writers
from quarrylight.streaming import incremental


def orders_nested(spark: SparkSession, sf: str):
    item = F.struct("o_orderkey", "o_orderstatus")
    nested = R.nest(table(spark, sf, "customer").select("c_custkey", "c_name"), table(spark, sf, "orders"), "c_custkey", "o_custkey", item)
    return nested.select("c_custkey", "c_name", F.array_join(F.transform("children", lambda x: F.concat_ws(":", x["o_orderkey"], x["o_orderstatus"])), ",").alias("orders"))


def first_owner(spark, sf):
    pairs = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).agg(F.min("l_orderkey").alias("first_order"))
    return R.first_owner(pairs, "part", "first_order", "supplier")


def bridge_categories(spark, sf):
    li = table(spark, sf, "lineitem")
    return R.bridge(table(spark, sf, "supplier"), "s_suppkey", li, table(spark, sf, "part"), "l_suppkey", "l_partkey", "p_partkey", "p_brand", "p_type").select("s_suppkey", F.array_join("names", ",").alias("names"))


def root_rows(spark, sf):
    rows = table(spark, sf, "guidestep").withColumn("at", F.concat_ws("|", F.date_format("loaded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.coalesce("title", F.lit(""))))
    return R.first_rows(rows.select("id", "at").distinct(), "id", "at")


def step_guides(spark, sf):
    rels = [R.Relationship("guide", "step", "id", "guideid"), R.Relationship("step", "section", "id", "stepid"), R.Relationship("section", "section", "id", "parentsectionid", "self_reference")]
    assert R.roots(["guide", "step", "section"], rels) == ["guide"]
    guides = table(spark, sf, "guide").select("id", F.coalesce("name", F.lit("")).alias("name")).distinct()
    steps = table(spark, sf, "guidestep").select(F.col("id").alias("step_id"), "guideid").distinct()
    return R.related(steps, guides, "guideid", "id", "many_to_one").select("step_id", "guideid", F.col("partner.name").alias("guide"))


def row_texts(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", R.row_lines("part", F.col("p_partkey"), ["p_name", "p_brand", "p_size"], 6).alias("lines"), R.structured_text(["p_name", "p_brand", "p_size"], "Part", ("p_brand",)).alias("structured"), R.summary(p.columns[:3]).alias("summary"))


def entity_texts(spark, sf):
    s = table(spark, sf, "guidestepsection").where("id IS NOT NULL")
    return s.select("id", "loaded_at", R.entity_text(F.concat(F.lit("Section "), F.col("id").cast("string")), F.col("content"), ["stepid", "parentsectionid"]).alias("text"), R.entity_text(F.lit("S"), F.lit(None).cast("string"), ["stepid", "parentsectionid"], False).alias("sorted"), R.row_id("section", "workbook", F.col("id")).alias("row_id")).distinct()


def entity_texts_whole(spark, sf):
    """The texts alone, of all sections whatever their content."""
    return entity_texts(spark, sf).drop("sorted").distinct()


def template_texts(spark, sf):
    c = table(spark, sf, "documents").select("doc_id", "title", "lang", "source")
    return c.select("doc_id", R.template_text("{title|untitled} [{lang|und}] from {source}{gone|!}", c.columns).alias("text"))


def guide_document(spark, sf):
    """Guides as documents: text, steps nested, base metadata and an id that stays."""
    steps = table(spark, sf, "guidestep").where("id IS NOT NULL").select("id", "guideid").distinct()
    g = table(spark, sf, "guide").groupBy("id").agg(F.max_by("name", "loaded_at").alias("name"))
    nested = R.nest(g, steps.withColumnRenamed("id", "step_id"), "id", "guideid", F.col("step_id"))
    meta = F.create_map(F.lit("source"), F.lit("workbook"), F.lit("source_type"), F.lit("relational"), F.lit("entity_name"), F.lit("guide"), F.lit("entity_id"), F.col("id").cast("string"))
    return nested.select(R.row_id("guide", "workbook", F.col("id")).alias("doc_id"), R.template_text("# {name|Guide}", ["name"]).alias("text"), F.array_join(F.transform("children", lambda x: x.cast("string")), ",").alias("steps"), F.array_join(F.transform(F.map_keys(meta), lambda k: F.concat_ws("=", k, F.element_at(meta, k))), ";").alias("metadata"))


def section_assets(spark, sf):
    """Images of all sections whose content is JSON with an image: read at the path, and from the image's own cell."""
    image = R.json_at(F.col("content"), "$.image.name")
    s = table(spark, sf, "guidestepsection").select("id", R.json_asset(F.col("content"), "image.name").alias("asset"), F.coalesce(R.json_asset(image), F.lit("")).alias("direct"))
    return s.where(F.col("asset").isNotNull()).distinct()


def section_assets_whole(spark, sf):
    return section_assets(spark, sf).drop("direct").distinct()


def event_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), M.relevance(F.col("value") / 100).alias("relevance"), M.combine("/", F.col("event_type"), F.col("user_id")).alias("combined"))


def metadata_merge(spark, sf):
    d = table(spark, sf, "documents")
    lang = M.extract([F.when(F.col("lang").rlike(M.LANGUAGE), F.col("lang")), F.lower(F.nullif(F.regexp_extract("lang", r"^([A-Za-z]{2})\b", 1), F.lit("")))], "en")
    kind = F.when(F.pmod("doc_id", F.lit(4)) == 0, "guide").when(F.pmod("doc_id", F.lit(4)) == 1, "faq")
    goal = M.purpose_by_pattern(F.col("text"), {"how_to": [r"(?i)step \d+"], "reference": ["reference", "overview"]})
    m = M.canonical(d.select("doc_id", "title", "source", "text", kind.alias("kind"), goal.alias("goal"), M.merge(F.col("lang"), F.lit("en")).alias("raw_lang"), lang.alias("language")))
    text = M.as_text(F.col("title"), F.col("kind"), F.col("goal"), F.col("source"), F.array().cast("array<string>"), F.col("created_at"), F.lit("2024"))
    return m.select("doc_id", "raw_lang", "language", F.col("goal"), text.alias("text"), F.col("updated_at").isNull().alias("filled"))


def validation(spark, sf):
    d = table(spark, sf, "documents")
    schema = [M.Field("title", required=True), M.Field("lang", required=True, pattern=M.LANGUAGE), M.Field("guide_key", "integer")]
    bad = M.problems({"title": F.col("title"), "lang": F.col("lang"), "guide_key": F.regexp_replace("guide_key", "^GK-", "")}, schema)
    return d.select("doc_id", F.array_join(bad, "; ").alias("problems"))


def file_names(spark, sf):
    a = table(spark, sf, "asset_file")
    c = M.path_context(F.concat(F.lit("/in/"), F.col("asset_name")))
    mime = F.when(F.col("asset_kind") == "image", "image/png").otherwise("application/pdf")
    return a.select("asset_name", c["stem"].alias("stem"), c["extension"].alias("extension"), writers.safe_filename(F.regexp_replace("asset_name", r"\.[^.]*$", ""), F.lit("x"), mime).alias("safe")).distinct()


def page_documents(spark, sf):
    d = readers.document_rows(readers.read_columns(spark, f"{sf}/page_export.parquet", required=readers.DOCUMENT_COLUMNS))
    return d.select("id", "text", F.try_element_at("metadata", F.lit("link")).alias("link"), F.try_element_at("metadata", F.lit("title")).alias("title"), F.size(F.map_keys("metadata")).alias("n_keys"), F.array_join("assets", ",").alias("assets"))


def union_sources(spark, sf):
    both = readers.union_all([table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "document_chunk").select("chunk_id", "source")])
    return both.groupBy("source").agg(F.count("doc_id").alias("n_docs"), F.count("chunk_id").alias("n_chunks"))


def workbook_cells(spark, sf):
    g = R.clean_columns(table(spark, sf, "guidedoc").select(F.col("row_no"), F.col("docname").alias("<doc|docname>"), "sectionid").distinct())
    return R.cells(g, "row_no", ["docname", "sectionid"]).distinct()


def answers(spark, sf):
    d = table(spark, sf, "documents").where("guide_key IS NOT NULL")
    return writers.answer_table(d, "guide_key", "title", "source")


def streamed_windows(spark, sf):
    w = incremental.run_windows(spark, sf, "events")
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


QUERIES = {f.__name__: f for f in (orders_nested, first_owner, bridge_categories, root_rows, step_guides, row_texts, entity_texts, entity_texts_whole, template_texts, guide_document, section_assets, section_assets_whole, event_json, metadata_merge, validation, file_names, page_documents, union_sources, workbook_cells, answers, streamed_windows)}

_LABELS = {k: " ".join(f"WHEN {k} = '{a}' THEN '{b}'" for a, b in v.items()) for k, v in (("kind", M.TYPE_LABELS), ("goal", M.PURPOSE_LABELS))}

_CONTENT = "CASE WHEN json_valid(content) AND json_type(content) = 'OBJECT' THEN coalesce(json_extract_string(content, '$.text'), json_extract_string(content, '$.content'), content) ELSE content END"
_TEXT = f"concat_ws(chr(10) || chr(10), '# Section ' || id, nullif({_CONTENT}, ''), '## Details', '| Field | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| stepid | ' || coalesce(stepid::VARCHAR, '') || ' |' || chr(10) || '| parentsectionid | ' || coalesce(parentsectionid::VARCHAR, '') || ' |')"
_IMAGE = "SELECT id, coalesce(json_extract_string(content, '$.image.name.path'), json_extract_string(content, '$.image.name.id'), CASE WHEN json_type(content, '$.image.name') <> 'OBJECT' THEN json_extract_string(content, '$.image.name') END) AS asset FROM guidestepsection WHERE json_valid(content)"

SQL = {
    "orders_nested": "SELECT c_custkey, c_name, coalesce(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey, o_orderstatus), '') AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL",
    "first_owner": "WITH p AS (SELECT l_partkey AS part, l_suppkey AS supplier, min(l_orderkey) AS first_order FROM lineitem GROUP BY ALL) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY first_order, supplier) = 1",
    "bridge_categories": "WITH n AS (SELECT l_suppkey, unnest([p_brand, p_type]) AS n FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT s_suppkey, coalesce(string_agg(DISTINCT n, ',' ORDER BY n), '') AS names FROM supplier LEFT JOIN n ON s_suppkey = l_suppkey GROUP BY 1",
    "root_rows": "WITH r AS (SELECT DISTINCT id, strftime(loaded_at, '%Y-%m-%dT%H:%M:%S.%f') || '|' || coalesce(title, '') AS at_ FROM guidestep) SELECT id, min(at_) AS \"at\" FROM r GROUP BY id",
    "step_guides": "WITH s AS (SELECT DISTINCT id AS step_id, guideid FROM guidestep), g AS (SELECT id, min(coalesce(name, '')) AS name FROM guide GROUP BY 1) SELECT step_id, guideid, name AS guide FROM s LEFT JOIN g ON guideid = g.id",
    "row_texts": """SELECT p_partkey, 'Sheet: part' || chr(10) || 'Row: ' || p_partkey || chr(10) || 'p_name: ' || CASE WHEN length(p_name) > 6 THEN left(p_name, 6) || '...' ELSE p_name END || chr(10) || 'p_brand: ' || CASE WHEN length(p_brand) > 6 THEN left(p_brand, 6) || '...' ELSE p_brand END || chr(10) || 'p_size: ' || p_size AS lines,
        'Part' || chr(10) || 'p_name: ' || p_name || CASE WHEN p_size <> 0 THEN chr(10) || 'p_size: ' || p_size ELSE '' END AS structured, 'p_partkey: ' || p_partkey || ', p_name: ' || p_name || ', p_brand: ' || p_brand AS summary FROM part""",
    "entity_texts": f"""SELECT DISTINCT id, loaded_at, {_TEXT} AS text,
        '# S' || chr(10) || chr(10) || '## Details' || chr(10) || chr(10) || '| Field | Value |' || chr(10) || '| --- | --- |' || chr(10) || concat_ws(chr(10), CASE WHEN parentsectionid IS NOT NULL THEN '| parentsectionid | ' || parentsectionid || ' |' END, CASE WHEN stepid IS NOT NULL THEN '| stepid | ' || stepid || ' |' END) AS sorted, 'section_workbook_' || id AS row_id FROM guidestepsection WHERE id IS NOT NULL""",
    "entity_texts_whole": f"SELECT DISTINCT id, loaded_at, {_TEXT} AS text, 'section_workbook_' || id AS row_id FROM guidestepsection WHERE id IS NOT NULL",
    "template_texts": "SELECT doc_id, CASE WHEN lower(coalesce(title, '')) IN ('', 'nan') THEN 'untitled' ELSE title END || ' [' || CASE WHEN lower(coalesce(lang, '')) IN ('', 'nan') THEN 'und' ELSE lang END || '] from ' || CASE WHEN lower(coalesce(source, '')) IN ('', 'nan') THEN '' ELSE source END || '!' AS text FROM documents",
    "guide_document": """WITH g AS (SELECT id, arg_max(coalesce(name, ''), loaded_at) AS name FROM guide GROUP BY 1), s AS (SELECT guideid, string_agg(id, ',' ORDER BY id) AS steps FROM (SELECT DISTINCT id, guideid FROM guidestep WHERE id IS NOT NULL) GROUP BY 1)
        SELECT 'guide_workbook_' || id AS doc_id, '# ' || CASE WHEN lower(name) IN ('', 'nan') THEN 'Guide' ELSE name END AS text, coalesce(steps, '') AS steps, 'source=workbook;source_type=relational;entity_name=guide;entity_id=' || id AS metadata FROM g LEFT JOIN s ON guideid = id""",
    "section_assets": f"WITH a AS ({_IMAGE}) SELECT DISTINCT id, asset, asset AS direct FROM a WHERE asset IS NOT NULL",
    "section_assets_whole": f"WITH a AS ({_IMAGE}) SELECT DISTINCT id, asset FROM a WHERE asset IS NOT NULL",
    "streamed_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "event_json": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, CASE WHEN value IS NULL THEN NULL WHEN value / 100 > 0.4 THEN 'high' WHEN value / 100 > 0.2 THEN 'medium' ELSE 'low' END AS relevance, concat_ws('/', nullif(event_type, ''), user_id::VARCHAR) AS combined FROM events",
    "metadata_merge": rf"""WITH d AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'guide' WHEN 1 THEN 'faq' END AS kind, CASE WHEN regexp_matches(text, '(?i)step \d+') THEN 'how_to' WHEN regexp_matches(text, 'reference|overview') THEN 'reference' END AS goal FROM documents)
        SELECT doc_id, coalesce(lang, 'en') AS raw_lang, coalesce(CASE WHEN regexp_matches(lang, '^[a-z]{{2}}(-[A-Z]{{2}})?$') THEN lang END, lower(nullif(regexp_extract(lang, '^([A-Za-z]{{2}})\b', 1), '')), 'en') AS language, goal,
        concat_ws(chr(10), 'Title: ' || title, CASE {_LABELS["kind"]} END, CASE {_LABELS["goal"]} END, 'Source: ' || source, 'Updated: 2024') AS text, true AS filled FROM d""",
    "validation": r"""SELECT doc_id, concat_ws('; ', CASE WHEN title IS NULL THEN 'title: missing' END, CASE WHEN lang IS NULL THEN 'lang: missing' END, CASE WHEN NOT regexp_matches(lang, '^[a-z]{2}(-[A-Z]{2})?$') THEN 'lang: pattern' END,
        CASE WHEN guide_key IS NOT NULL AND try_cast(regexp_replace(guide_key, '^GK-', '') AS BIGINT) IS NULL THEN 'guide_key: not a integer' END) AS problems FROM documents""",
    "file_names": r"""SELECT DISTINCT asset_name, regexp_replace(regexp_extract(asset_name, '([^/\\]*)$', 1), '\.[^.]*$', '') AS stem, lower(regexp_extract(regexp_extract(asset_name, '([^/\\]*)$', 1), '(\.[^.]*)$', 1)) AS extension,
        CASE WHEN contains(b, '.') THEN b ELSE b || CASE WHEN asset_kind = 'image' THEN '.png' ELSE '.pdf' END END AS safe FROM (SELECT *, coalesce(nullif(regexp_replace(asset_name, '\.[^.]*$', ''), ''), 'x') AS b FROM asset_file)""",
    "page_documents": "SELECT id::VARCHAR AS id, content AS text, link, title, (1 + (link IS NOT NULL)::INT + (title IS NOT NULL)::INT + (crawled_at IS NOT NULL)::INT)::INT AS n_keys, coalesce(array_to_string(images, ','), '') AS assets FROM page_export",
    "union_sources": "SELECT source, count(doc_id) AS n_docs, count(chunk_id) AS n_chunks FROM (SELECT doc_id, NULL AS chunk_id, source FROM documents UNION ALL SELECT NULL, chunk_id, source FROM document_chunk) GROUP BY 1",
    "workbook_cells": "SELECT DISTINCT row_no, 0 AS pos, docname AS cell FROM guidedoc WHERE docname IS NOT NULL UNION SELECT DISTINCT row_no, 1, sectionid FROM guidedoc WHERE sectionid IS NOT NULL",
    "answers": "SELECT guide_key, min(title) AS title, coalesce(string_agg(DISTINCT source, ', ' ORDER BY source), '') AS sources FROM documents WHERE guide_key IS NOT NULL GROUP BY 1",
}
