"""Queries over whole pipelines: documents enriched, assembled, retrieved and answered from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import chunking
from quarrylight.operators import classify as C
from quarrylight.operators import conversation as V
from quarrylight.operators import metadata as M
from quarrylight.operators import orphans as O
from quarrylight.operators import prompts as P
from quarrylight.operators import relational as R
from quarrylight.operators import vectors as X
from quarrylight.operators.skew import spread, valid_version
from quarrylight.plans.relations import table
from quarrylight.plans.retrieval import DOMAINS, PURPOSES, SUBDOMAINS, TERMS
from quarrylight.scratch import scratch_dir
from quarrylight.sources import readers, writers

CATEGORIES = {"events": [("auction", 1.0), ("round", 0.5)], "documents": [("contract", 1.0), ("guide", 0.4)]}
DICTIONARIES = C.Dictionaries(DOMAINS, SUBDOMAINS, PURPOSES, CATEGORIES, TERMS)


def _hits(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """Every vector whose id is divisible by 50 as a query against all vectors, with the documents of the hits."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    hits = X.top_k(e, e.where(F.col("vec_id") % 50 == 0), k=k)
    return X.retrieved(hits, table(spark, sf, "documents").select("doc_id", "title", "text", "source"), "doc_id")


def retrieved_documents(spark, sf):
    return _hits(spark, sf, 5).select("query_id", "rank", "id", "score", "title", "text", "source")


def rag_answers(spark, sf):
    asked = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.coalesce("title", F.lit("")).alias("question"))
    hits = _hits(spark, sf, 3).join(asked, "query_id")
    return P.answer_queries(hits, "query_id", "rank", F.col("question"), F.lit("General"), F.col("text"), F.col("source"), F.col("title"), F.col("source"))


def question_domains(spark, sf):
    q = table(spark, sf, "documents").select("doc_id", F.posexplode(C.question_domains(F.col("title"), DOMAINS)).alias("idx", "x"))
    return q.select("doc_id", "idx", "x.category", F.round("x.score", 6).alias("score"))


def question_classes(spark, sf):
    q = table(spark, sf, "eval_item").select("item_id", C.classify_question(F.col("item_text"), DOMAINS).alias("c"))
    names = F.array_join(F.transform("c.domains", lambda x: x["category"]), ",")
    others = F.array_join(F.transform("c.alternatives", lambda x: x["category"]), ",")
    return q.select("item_id", names.alias("domains"), "c.prompt_type", F.round("c.confidence", 6).alias("confidence"), others.alias("alternatives"))


def semantic_domains(spark, sf):
    e = table(spark, sf, "embeddings")
    labels = e.groupBy(F.concat(F.lit("label "), F.col("label").cast("string")).alias("label")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    near = X.nearest_label(e, "vec_id", "embedding", labels).withColumnRenamed("vec_id", "doc_id")
    d = table(spark, sf, "documents").select("doc_id", C.question_domains(F.col("title"), DOMAINS).alias("domains"))
    best = C.with_fallback(F.col("domains"), F.col("label"), F.col("score"))[0]
    return d.join(near, "doc_id", "left").select("doc_id", best["category"].alias("domain"), F.round(best["score"], 6).alias("score"))


def title_tags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(C.title_domains(F.col("title"), DOMAINS), ",").alias("product_domains"))


def enriched_documents(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "title", "text", F.col("source").alias("tags")))
    rows = C.clean_and_enrich(d, "text", "title", DICTIONARIES, tags=False)
    joined = [F.array_join(c, ",").alias(c) for c in ("domains", "categories", "subdomains")]
    return rows.select("doc_id", "text", "tags", *joined, "content_purpose")


def enriched_tags(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "title", "text"))
    rows = C.clean_and_enrich(d, "text", "title", DICTIONARIES)
    return rows.select("doc_id", F.posexplode("tags").alias("idx", "tag"))


def appended_messages(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.lit("user").alias("role"), F.col("event_type").alias("text"), F.col("ts").alias("created_at"), "value")
    old, new = e.where("value < 50 OR value IS NULL"), e.where("value >= 50")
    return V.append(old.drop("value"), new.drop("turn", "value")).select("conv_id", "turn", "text", "created_at")


def row_json(spark, sf):
    s = table(spark, sf, "guidestepsection").select("id", "stepid", "content", "loaded_at")
    columns = ["id", "stepid", "content"]
    back = R.from_json_row(F.col("row"), s, columns)
    rows = s.withColumn("row", R.as_json(s, columns))
    return rows.select(back["id"].alias("id"), back["stepid"].alias("stepid"), back["content"].alias("content"), R.field_value(F.col("content"), 20).alias("shown"), R.field_value(F.col("stepid")).alias("step"), "loaded_at")


def assembled_sections(spark, sf):
    """Sections as documents with their child sections and the documents that name them."""
    s = valid_version(table(spark, sf, "guidestepsection").select("id", "stepid", "parentsectionid", "content", "loaded_at"), "id").drop("first_loaded")
    docs = valid_version(table(spark, sf, "guidedoc").select("row_no", "docname", O.whole_number(F.col("sectionid")).alias("sectionid"), "loaded_at"), "row_no").drop("first_loaded")
    children = {
        "section": (s.select("id", "parentsectionid", "content"), R.Relationship("section", "section", "id", "parentsectionid"), "id"),
        "guidedoc": (docs.select("row_no", "docname", "sectionid"), R.Relationship("section", "guidedoc", "id", "sectionid", "many_to_one"), "row_no"),
    }
    text = R.entity_text(F.concat(F.lit("Section "), F.col("id").cast("string")), F.col("content"), ["stepid", "parentsectionid"])
    made = R.assemble("section", "workbook", s, "id", text, children, ("stepid",), F.array_compact(F.array(R.json_asset(F.col("content"), "image.name"))))
    shape = "entity struct<id:bigint>, relationships struct<section:struct<type:string,data:array<struct<id:bigint,data:struct<content:string>>>>,guidedoc:struct<type:string,data:array<struct<id:bigint,data:struct<docname:string>>>>>"
    x = F.from_json("structured", shape)
    kids, named = x["relationships"]["section"], x["relationships"]["guidedoc"]
    meta = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda m: F.concat(m["key"], F.lit("="), m["value"]))), ";")
    return made.select(
        "id", x["entity"]["id"].alias("section_id"), "text", meta.alias("metadata"), F.array_join("assets", ",").alias("assets"), kids["type"].alias("section_type"), named["type"].alias("doc_type"),
        F.array_join(F.transform(kids["data"], lambda k: F.concat_ws(":", k["id"].cast("string"), k["data"]["content"])), "|").alias("sections"),
        F.array_join(F.transform(named["data"], lambda k: F.concat_ws(":", k["id"].cast("string"), k["data"]["docname"])), "|").alias("docs"),
    )


def source_paths(spark, sf):
    d = readers.with_source(spark.read.parquet(f"{sf}/documents.parquet"))
    return d.select("doc_id", F.regexp_extract("source_path", r"([^/]+\.parquet)(?:/[^/]*)?$", 1).alias("source_file"))


def page_metadata(spark, sf):
    """Pages as an HTML scan gives them: text, title, and the meta tags with what is known of the file."""
    p = table(spark, sf, "page_export").select(F.concat(F.lit("/in/"), F.col("id").cast("string"), F.lit(".html")).alias("path"), "content")
    rows = readers.html_documents(p)
    meta = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda m: F.concat(m["key"], F.lit("="), m["value"]))), ";")
    return rows.select("path", F.length("text").alias("n_chars"), meta.alias("metadata"), "error")


def html_sections(spark, sf):
    rows = chunking.html_sections(table(spark, sf, "page_export").select(F.col("id").alias("page_id"), "content"), "content")
    return rows.select("page_id", "chunk_index", "chunk_type", "heading", "chunk")


def metadata_rules(spark, sf):
    rows = table(spark, sf, "pipeline_row").select("row_id", F.create_map(F.lit("dataset"), "dataset", F.lit("metadata"), "metadata", F.lit("id"), "row_id").alias("m"))
    rules = [M.MapField("dataset", "name"), M.ExtractJson("metadata", "title", "title"), M.CombineFields(("name", "title"), "label", " / ")]
    made = M.apply_rules(F.map_filter("m", lambda _, v: v.isNotNull()), rules)
    both = M.normalized(F.array("row_id", F.col("m")["dataset"]))
    return rows.select("row_id", *[F.try_element_at(made, F.lit(k)).alias(k) for k in ("name", "title", "label")], both.alias("both"))


def metadata_schemas(spark, sf):
    d = table(spark, sf, "documents")
    core = {"title": [F.nullif("title", F.lit(""))], "language": [F.when(F.col("lang").rlike(M.LANGUAGE), F.col("lang"))]}
    content = {"title": [T.first_heading(F.col("text")), T.field_line(F.col("text"), "title")], "author": [T.field_line(F.col("text"), "author")]}
    special = {"language": [F.lit("en")], "author": [F.col("customer_id")]}
    return d.select("doc_id", *[c.alias(k) for k, c in M.extract_schemas([core, content, special]).items()])


def csv_documents(spark, sf):
    """Documents through a CSV file and back."""
    out = scratch_dir(spark)
    table(spark, sf, "documents").select("doc_id", "title", "text").write.option("header", "true").option("escape", '"').option("quoteAll", "true").csv(out)
    return readers.read_csv(spark, out, "doc_id bigint, title string, text string", multiLine="true", escape='"')


def jsonl_pages(spark, sf):
    """Pages through lines of JSON and back; broken lines and empty contents are left out."""
    out = scratch_dir(spark)
    pages = table(spark, sf, "page_export").select(F.to_json(F.struct("link", "content")).alias("value"))
    pages.unionByName(pages.select(F.concat(F.lit("{"), F.left("value", F.lit(9))).alias("value"))).write.text(out)
    return readers.read_jsonl(spark, out)


def logged_events(spark, sf):
    """Events as a log by kind and day, read back."""
    out = scratch_dir(spark)
    writers.write_log(table(spark, sf, "events").select("event_id", "ts", "event_type", "value"), out)
    log = spark.read.schema("event_id bigint, value double, event_type string, day string").json(out)
    return log.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def stored_index(spark, sf):
    """Chunks of documents with their embedding added to an index in two batches, the second without what is there."""
    out = scratch_dir(spark)
    e = table(spark, sf, "embeddings")
    writers.append_index(e.where("vec_id % 3 = 0"), out)
    writers.append_index(X.unseen(e, spark.read.schema(e.schema).parquet(out), "vec_id"), out)
    return spark.read.schema(e.schema).parquet(out).select("vec_id", "label", F.size("embedding").alias("dim"))


def built_index(spark, sf):
    """Documents chunked, embedded and stored in two runs, the second over all of them; each chunk's text is there once."""
    out = scratch_dir(spark)
    d = table(spark, sf, "documents").select("doc_id", "text")
    writers.build_index(d.where("doc_id % 2 = 0"), out, size=100, overlap=20)
    writers.build_index(d, out, size=100, overlap=20)
    return spark.read.parquet(out).select("sha", "token_count", F.size("embedding").alias("dim"))


def discovered_rows(spark, sf):
    """Documents in files of several folders, found and put below each other."""
    out = scratch_dir(spark)
    d = table(spark, sf, "documents").select("doc_id", "source")
    d.where("doc_id % 2 = 0").write.parquet(f"{out}/a")
    d.where("doc_id % 2 = 1").drop("source").write.parquet(f"{out}/deep/b")
    return readers.read_all(spark, out).select("doc_id", "source")


QUERIES = {
    f.__name__: f for f in (
        retrieved_documents, rag_answers, question_domains, question_classes, semantic_domains, title_tags, enriched_documents, enriched_tags, appended_messages, row_json, assembled_sections,
        source_paths, page_metadata, html_sections, metadata_rules, metadata_schemas, csv_documents, jsonl_pages, logged_events, stored_index, built_index, discovered_rows,
    )
}

_KEYWORDS = {
    "d": [("sourcing", "auction", 1.5), ("sourcing", "supplier", 1.0), ("sourcing", "bid", 1.0), ("contracts", "contract", 1.0), ("contracts", "clause", 0.8), ("contracts", "licence", 1.0), ("logistics", "warehouse", 1.2), ("logistics", "freight", 1.0), ("logistics", "pallet", 0.5), ("sourcing_events", "scenario", 0.7), ("sourcing_events", "round", 0.3)],
    "s": [("sourcing_events", "scenario", 0.7), ("sourcing_events", "round", 0.3), ("sourcing_auctions", "auction", 1.0), ("contracts_clauses", "clause", 1.0), ("logistics_freight", "freight", 0.9)],
    "c": [("events", "auction", 1.0), ("events", "round", 0.5), ("documents", "contract", 1.0), ("documents", "guide", 0.4)],
    "p": [("how_to", "how to", 2.0), ("how_to", "open the", 0.5), ("explanation", "what is", 2.0), ("explanation", "explains", 1.0), ("reference", "reference", 2.0), ("reference", "overview", 1.0)],
}


def _scored(name: str, where: str, key: str = "doc_id", value: str = "CASE WHEN contains(lower(coalesce(title, '')), w) THEN 2 * x WHEN contains(lower(coalesce(text, '')), w) THEN x ELSE 0 END") -> str:
    """Scores of categories in the order of their keywords, as a table (key, category, ord, score)."""
    rows = ", ".join(f"({i}, '{c}', '{w}', {x}::DOUBLE)" for i, (c, w, x) in enumerate(_KEYWORDS[name]))
    return f"SELECT {key}, category, min(ord) AS ord, sum({value}) AS score FROM {where}, (VALUES {rows}) AS k(ord, category, w, x) GROUP BY {key}, category"


_TOP = """s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS s FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0),
    h AS (SELECT r.*, title, text, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, id) AS rank FROM s) r LEFT JOIN documents ON doc_id = id)"""
_PLAIN = "regexp_replace(text, '<[^>]+>', '', 'g')"
_TAGGED = "regexp_matches(text, '</?(?:div|span|p|h[1-6]|ul|ol|li|table|html|body|head)(?:\\s|>)')"
_SPACES = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_HALF = "CASE WHEN contains(lower(coalesce(title, '')), w) THEN 0.5 * x ELSE 0 END"
_CLEAN = f"d AS (SELECT doc_id, title, source, trim(regexp_replace(text, '{_SPACES}', ' ', 'g')) AS text FROM documents)"
_BODY = "CASE WHEN content IS NULL THEN NULL WHEN json_valid(content) AND json_type(content) = 'OBJECT' THEN coalesce(json_extract_string(content, '$.text'), json_extract_string(content, '$.content'), content) ELSE content END"

SQL = {
    "retrieved_documents": f"WITH {_TOP} SELECT query_id, rank::INT AS rank, id, round(s, 6) AS score, title, text, source FROM h WHERE rank <= 5",
    "rag_answers": f"""WITH {_TOP}, k AS (SELECT h.*, coalesce(d.title, '') AS question FROM h JOIN documents d ON d.doc_id = query_id WHERE rank <= 3),
        e AS (SELECT query_id, string_agg('[Source](' || coalesce(source, '#') || ')' || chr(10) || CASE WHEN {_TAGGED.replace("text", "left(text, 2048)", 1)} THEN {_PLAIN.replace("text", "left(text, 2048)", 1)} ELSE left(text, 2048) END, chr(10) || chr(10) ORDER BY rank) FILTER (WHERE text <> '') AS body FROM k GROUP BY 1),
        b AS (SELECT query_id, arg_min(CASE WHEN {_TAGGED} THEN {_PLAIN} ELSE text END, rank) FILTER (WHERE trim(text) <> '') AS t, arg_min(question, rank) AS question FROM k GROUP BY 1),
        a AS (SELECT query_id, question, coalesce(array_to_string(list_filter(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')[1:2], ' '), '') AS answer FROM b),
        n AS (SELECT query_id, coalesce(nullif(title, ''), nullif(source, '')) AS name, min(rank) AS r FROM k GROUP BY 1, 2),
        c AS (SELECT query_id, chr(10) || '**Cited guides:**' || chr(10) || string_agg('- ' || name, chr(10) ORDER BY r) AS citations FROM n WHERE name IS NOT NULL GROUP BY 1)
        SELECT query_id, 'Domain: General' || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || chr(10) || chr(10) || 'Context:' || coalesce(chr(10) || chr(10) || body, '') AS prompt, answer, coalesce(citations, '') AS citations,
        answer || coalesce(chr(10) || chr(10) || citations, '') AS response FROM a LEFT JOIN e USING (query_id) LEFT JOIN c USING (query_id)""",
    "question_domains": f"""WITH s AS ({_scored("d", "documents", value=_HALF)}), f AS (SELECT * FROM s WHERE score > 0)
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) - 1)::INT AS idx, category, round(score / max(score) OVER (PARTITION BY doc_id), 6) AS score FROM f
        UNION ALL SELECT doc_id, 0, 'General', 0.0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f)""",
    "question_classes": f"""WITH q AS (SELECT item_id, item_text AS title FROM eval_item), s AS ({_scored("d", "q", "item_id", _HALF)}),
        d AS (SELECT item_id, string_agg(category, ',' ORDER BY score DESC, ord) AS domains FROM s WHERE score > 0 GROUP BY 1),
        t AS (SELECT item_id, ord, kind, sum(CASE WHEN contains(lower(title), w) THEN x ELSE 0 END) AS score FROM q, (VALUES (0, 'How to', 'how do i', 1.0::DOUBLE), (0, 'How to', 'how to', 1.0), (0, 'How to', 'steps to', 0.8), (0, 'How to', 'guide', 0.6),
            (1, 'Show me', 'show me', 1.0), (1, 'Show me', 'display', 0.8), (1, 'Show me', 'can i see', 0.9), (2, 'Question', 'what is', 1.0), (2, 'Question', 'why', 0.9), (2, 'Question', 'explain', 0.8), (2, 'Question', 'where', 0.7), (2, 'Question', 'when', 0.7),
            (3, 'Troubleshooting', 'error', 1.0), (3, 'Troubleshooting', 'issue', 0.9), (3, 'Troubleshooting', 'problem', 0.9), (3, 'Troubleshooting', 'fix', 0.8), (3, 'Troubleshooting', 'resolve', 0.8), (4, 'General', 'info', 0.5), (4, 'General', 'information', 0.5)) AS k(ord, kind, w, x) GROUP BY 1, 2, 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, ord) AS k FROM t WHERE score > 0),
        p AS (SELECT item_id, max(kind) FILTER (WHERE k = 1) AS kind, max(score) FILTER (WHERE k = 1) AS score, string_agg(kind, ',' ORDER BY k) FILTER (WHERE k > 1) AS others FROM r GROUP BY 1)
        SELECT q.item_id, coalesce(domains, 'General') AS domains, coalesce(kind, 'General') AS prompt_type, round(coalesce(score, 0), 6) AS confidence, coalesce(others, '') AS alternatives FROM q LEFT JOIN d USING (item_id) LEFT JOIN p USING (item_id)""",
    "semantic_domains": f"""WITH s AS ({_scored("d", "documents", value=_HALF)}), b AS (SELECT doc_id, arg_max(category, score * 1000 - ord) AS category FROM s WHERE score > 0 GROUP BY 1),
        l AS (SELECT 'label ' || label AS label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label),
        m AS (SELECT vec_id, l.label, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 9) AS sim FROM embeddings, l),
        n AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) = 1)
        SELECT d.doc_id, coalesce(b.category, n.label, 'General') AS domain, CASE WHEN b.category IS NOT NULL THEN 1.0 ELSE coalesce(round(sim, 6), 0.0) END AS score FROM documents d LEFT JOIN b USING (doc_id) LEFT JOIN n ON vec_id = doc_id""",
    "title_tags": f"""WITH s AS ({_scored("d", "documents", value="CASE WHEN contains(lower(coalesce(title, '')), w) THEN 1 ELSE 0 END")})
        SELECT doc_id, coalesce(string_agg(category, ',' ORDER BY ord) FILTER (WHERE score > 0), '') AS product_domains FROM s GROUP BY doc_id""",
    "enriched_documents": f"""WITH {_CLEAN}, dd AS ({_scored("d", "d")}), ss AS ({_scored("s", "d")}), cc AS ({_scored("c", "d")}), pp AS ({_scored("p", "d")}),
        a AS (SELECT doc_id, string_agg(category, ',' ORDER BY score DESC, ord) AS domains, list(category) AS names FROM dd WHERE score > 0 GROUP BY 1),
        k AS (SELECT doc_id, string_agg(category, ',' ORDER BY score DESC, ord) AS categories FROM cc WHERE score > 0 GROUP BY 1),
        b AS (SELECT ss.doc_id, string_agg(category, ',' ORDER BY score DESC, ord) AS subdomains FROM ss LEFT JOIN a ON a.doc_id = ss.doc_id WHERE score > 0 AND (names IS NULL OR len(list_filter(names, lambda n: category = n OR starts_with(category, n || '_'))) > 0) GROUP BY 1),
        q AS (SELECT pp.doc_id, category, ord, score + CASE WHEN category = 'how_to' AND regexp_matches(lower(text), 'step \\d+|\\d+\\.\\s') THEN 3 ELSE 0 END AS score FROM pp JOIN d USING (doc_id)),
        w AS (SELECT doc_id, category FROM q WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) = 1)
        SELECT d.doc_id, text, source AS tags, coalesce(domains, '') AS domains, coalesce(categories, '') AS categories, coalesce(subdomains, '') AS subdomains, coalesce(w.category, 'unknown') AS content_purpose
        FROM d LEFT JOIN a USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN w USING (doc_id)""",
    "appended_messages": """WITH l AS (SELECT user_id, max(event_id) AS last FROM events WHERE value < 50 OR value IS NULL GROUP BY 1)
        SELECT user_id AS conv_id, event_id AS turn, event_type AS text, ts AS created_at FROM events WHERE value < 50 OR value IS NULL
        UNION ALL SELECT user_id, coalesce(last, 0) + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type), event_type, ts FROM events LEFT JOIN l USING (user_id) WHERE value >= 50 AND user_id IS NOT NULL""",
    "row_json": "SELECT id, stepid, content, CASE WHEN length(content) > 20 THEN left(content, 20) || '...' ELSE coalesce(content, '') END AS shown, coalesce(stepid::VARCHAR, '') AS step, loaded_at FROM guidestepsection",
    "assembled_sections": f"""WITH s AS (SELECT * FROM guidestepsection WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1),
        g AS (SELECT row_no, docname, try_cast(nullif(regexp_extract(sectionid, '^\\s*(\\d+)(\\.0)?\\s*$', 1), '') AS BIGINT) AS sectionid FROM guidedoc WHERE row_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY loaded_at DESC) = 1),
        k AS (SELECT parentsectionid AS id, string_agg(concat_ws(':', id, content), '|' ORDER BY id) AS sections FROM s WHERE parentsectionid IS NOT NULL GROUP BY 1),
        n AS (SELECT sectionid AS id, string_agg(concat_ws(':', row_no, docname), '|' ORDER BY row_no) AS docs FROM g WHERE sectionid IS NOT NULL GROUP BY 1)
        SELECT 'relational_workbook_section_' || s.id AS id, s.id AS section_id, concat_ws(chr(10) || chr(10), '# Section ' || s.id, nullif({_BODY}, ''), '## Details', '| Field | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| stepid | ' || coalesce(stepid::VARCHAR, '') || ' |' || chr(10) || '| parentsectionid | ' || coalesce(parentsectionid::VARCHAR, '') || ' |') AS text,
        concat_ws(';', 'entity_id=' || s.id, 'entity_name=section', 'source=workbook', 'source_type=relational_data', 'stepid=' || stepid) AS metadata,
        coalesce(CASE WHEN json_valid(content) THEN json_extract_string(content, '$.image.name') END, '') AS assets, 'one_to_many' AS section_type, 'many_to_one' AS doc_type, coalesce(sections, '') AS sections, coalesce(docs, '') AS docs
        FROM s LEFT JOIN k ON k.id = s.id LEFT JOIN n ON n.id = s.id""",
    "source_paths": "SELECT doc_id, 'documents.parquet' AS source_file FROM documents",
    "html_sections": r"""WITH p AS (SELECT id AS page_id, list_filter(string_split(regexp_replace(regexp_replace(content, '(?i)(<h[1-3]\b)', chr(1) || '\1', 'g'), '(?is)(<figure\b.*?</figure\s*>)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, E' \t\n\r\f\x0B') <> '') AS c FROM page_export)
        SELECT page_id, i - 1 AS chunk_index, CASE WHEN regexp_matches(c[i], '(?i)^<figure\b') THEN 'figure' WHEN regexp_matches(c[i], '(?i)^<h[1-3]\b') THEN 'section' ELSE 'lead' END AS chunk_type, nullif(regexp_extract(c[i], '(?is)^<h[1-3]\b[^>]*>([^<]*)', 1), '') AS heading, c[i] AS chunk FROM p, unnest(range(1, len(c) + 1)) AS u(i)""",
    "metadata_rules": """WITH r AS (SELECT *, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.title') END AS title FROM pipeline_row)
        SELECT row_id, dataset AS name, title, nullif(concat_ws(' / ', nullif(dataset, ''), nullif(title, '')), '') AS label, to_json([row_id, dataset]) AS both FROM r""",
    "metadata_schemas": r"""SELECT doc_id, coalesce(nullif(title, ''), nullif(regexp_extract(text, '(?m)^#\s+(.+)$', 1), ''), nullif(regexp_extract(text, '(?:Title|TITLE):\s*(.+)(?:\n|$)', 1), '')) AS title,
        coalesce(CASE WHEN regexp_matches(lang, '^[a-z]{2}(-[A-Z]{2})?$') THEN lang END, 'en') AS language, coalesce(nullif(regexp_extract(text, '(?:Author|AUTHOR):\s*(.+)(?:\n|$)', 1), ''), customer_id) AS author FROM documents""",
    "csv_documents": "SELECT doc_id, title, text FROM documents",
    "jsonl_pages": "SELECT link, content FROM page_export WHERE content IS NOT NULL AND trim(content) <> ''",
    "logged_events": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1, 2",
    "stored_index": "SELECT vec_id, label, len(embedding)::INT AS dim FROM embeddings",
    "built_index": f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_SPACES}'), lambda x: x <> '') AS w FROM documents),
        c AS (SELECT w[i:i + 99] AS part FROM w, unnest(range(1, len(w) + 1, 80)) AS u(i))
        SELECT DISTINCT sha256(array_to_string(part, ' ')) AS sha, len(part)::INT AS token_count, 64 AS dim FROM c""",
    "discovered_rows": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source END AS source FROM documents",
}
