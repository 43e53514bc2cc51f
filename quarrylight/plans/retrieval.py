"""Queries on classification, vectors, conversations and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.operators import classify as C
from quarrylight.operators import conversation as V
from quarrylight.operators import prompts as P
from quarrylight.operators import vectors as X
from quarrylight.operators.skew import spread
from quarrylight.plans.relations import table

DOMAINS = {"sourcing": [("auction", 1.5), ("supplier", 1.0), ("bid", 1.0)], "contracts": [("contract", 1.0), ("clause", 0.8), "licence"], "logistics": [("warehouse", 1.2), ("freight", 1.0), ("pallet", 0.5)], "sourcing_events": [("scenario", 0.7), ("round", 0.3)]}
SUBDOMAINS = {"sourcing_events": [("scenario", 0.7), ("round", 0.3)], "sourcing_auctions": [("auction", 1.0)], "contracts_clauses": [("clause", 1.0)], "logistics_freight": [("freight", 0.9)]}
TERMS = {"award": 0.8, "basket": 0.7}
PURPOSES = {"how_to": [("how to", 2.0), ("open the", 0.5)], "explanation": [("what is", 2.0), ("explains", 1.0)], "reference": [("reference", 2.0), ("overview", 1.0)]}


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "title", "text", "source", "guide_key"))


def keyphrases(spark, sf):
    return C.keyphrases(docs(spark, sf), "doc_id", F.col("text"), F.col("title"))


def keyphrases_hybrid(spark, sf):
    lists = C.phrase_lists(docs(spark, sf), {"t": (F.col("title"), None, 3), "p": (F.col("text"), None, 8)}, ["doc_id"])
    rows = lists.select("doc_id", F.posexplode(C.hybrid(F.col("t"), F.col("p"), 8)).alias("pos", "x"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("rank"), "x.phrase", "x.score")


def keyword_domains(spark, sf):
    scores = C.category_scores(F.col("text"), F.col("title"), DOMAINS)
    scored = docs(spark, sf).select("doc_id", scores.alias("s")).select("doc_id", F.get("s", F.lit(0))["score"].alias("best"), F.posexplode("s").alias("idx", "x"))
    return scored.select("doc_id", "idx", "x.category", F.round("x.score", 6).alias("score"), F.round(F.col("x.score") / F.col("best"), 6).alias("relative"))


def content_purpose(spark, sf):
    d = docs(spark, sf)
    scores = C.category_scores(F.col("text"), F.col("title"), DOMAINS)
    kept = C.subdomains(scores, F.array(F.lit("sourcing")))
    return d.select("doc_id", C.purpose(F.col("text"), F.col("title"), PURPOSES).alias("purpose"), F.array_join(F.array_sort(F.transform(kept, lambda s: s["category"])), ",").alias("subdomains"))


def prompt_type(spark, sf):
    best = C.prompt_types(F.col("text"))
    return docs(spark, sf).select("doc_id", best[0]["category"].alias("prompt_type"), F.round(best[0]["score"], 6).alias("confidence"), F.array_join(F.transform(F.slice(best, 2, 10), lambda s: s["category"]), ",").alias("others"), C.query_type(F.col("title")).alias("query_type"))


def keyword_density(spark, sf):
    return docs(spark, sf).select("doc_id", C.keyword_density(F.col("text")).alias("d")).select("doc_id", "d.*")


def tag_fusion(spark, sf):
    rows = C.enrich(docs(spark, sf).select("doc_id", "text", "title"), "text", "title", C.Dictionaries(DOMAINS, SUBDOMAINS, PURPOSES, terms=TERMS), scores=True)
    return rows.select("doc_id", F.posexplode("tags").alias("idx", "x")).select("doc_id", "idx", "x.tag", F.round("x.score", 6).alias("score"))


def _asked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries every one whose id is divisible by 50."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return e, e.where(F.col("vec_id") % 50 == 0)


def topk_cosine(spark, sf):
    e, q = _asked(spark, sf)
    hits = X.top_k(e, q, metric="cosine")
    return hits.withColumn("compatible", F.round(X.compatible_score(F.col("score")), 6))


def topk_ip(spark, sf):
    return X.top_k(*_asked(spark, sf), metric="dot")


def topk_l2(spark, sf):
    return X.top_k(*_asked(spark, sf), metric="euclidean")


def hits_by_label(spark, sf):
    e, q = _asked(spark, sf)
    hits = X.top_k(e, q, k=10).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    kept = X.best_per_source(hits, "query_id", "rank", F.when(F.col("label") % 3 != 0, F.col("label")), F.when(F.col("label") % 6 != 0, F.col("label") + 100))
    return X.above(kept, -1.0).select("query_id", "rank", "id", "label")


def index_routing(spark, sf):
    d = docs(spark, sf)
    return d.select("doc_id", X.route(F.lower("source"), F.when(F.col("doc_id") % 7 == 0, F.lit("archive")), ["faq", "marketing", "product_doc"]).alias("index"))


def incremental_rows(spark, sf):
    rows = table(spark, sf, "pipeline_row")
    key = X.identity(F.lit(None).cast("string"), F.get_json_object("metadata", "$.id"), F.get_json_object("metadata", "$.source"), F.col("text"))
    known = rows.where("loaded_at < timestamp '2024-01-01'").select(key.alias("key")).where("key IS NOT NULL").distinct()
    return X.unseen(rows.withColumn("key", key), known, "key").select("key")


def unseen_texts(spark, sf):
    chunks = table(spark, sf, "document_chunk").select(F.sha2("content", 256).alias("sha"), "created_at")
    known = chunks.where("created_at < timestamp '2024-01-01'").select("sha").where("sha IS NOT NULL").distinct()
    return X.unseen(chunks.where("created_at >= timestamp '2024-01-01'"), known, "sha").select("sha")


def text_neighbours(spark, sf):
    return X.top_k(X.embed(docs(spark, sf), "doc_id", "text"), X.embed(table(spark, sf, "eval_item"), "item_id", "item_text"), k=3)


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of a source as the messages of a conversation."""
    role = F.when(F.pmod(F.substring("chunk_id", -2, 2).cast("int"), F.lit(10)) == 0, "system").when(F.pmod(F.substring("chunk_id", -1, 1).cast("int"), F.lit(2)) == 0, "user").otherwise("assistant")
    return table(spark, sf, "document_chunk").select(F.col("source").alias("conv_id"), F.col("chunk_id").alias("turn"), role.alias("role"), F.col("content").alias("text"), "created_at")


def history_trim(spark, sf):
    return V.trim_history(messages(spark, sf), budget=300).select("conv_id", "turn", "role", "tokens")


def conversation_headers(spark, sf):
    h = V.headers(messages(spark, sf))
    return h.withColumn("summary", V.summary(F.when(F.col("message_count") > 1, F.col("conv_id")), F.col("message_count")))


def newest_conversations(spark, sf):
    last = messages(spark, sf).groupBy("conv_id").agg(F.max("created_at").alias("updated_at"))
    return V.newest(last, "updated_at", "conv_id", 20, 5)


def message_json(spark, sf):
    m = P.sendable(messages(spark, sf), ("system", "user")).withColumn("json", V.to_json(F.col("role"), F.col("text"), F.col("created_at")))
    back = V.from_json(F.col("json"))
    return m.select("turn", back["role"].alias("role"), back["content"].alias("content"), back["timestamp"].alias("timestamp"))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as the hits of the question that their guide key stands for, the newest first."""
    d = table(spark, sf, "documents").where("guide_key IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("guide_key").orderBy(F.desc("loaded_at"), "doc_id"))
    return d.select(F.col("guide_key").alias("query_id"), rank.alias("rank"), "doc_id", "title", "text", "source").where(F.col("rank") <= 3)


def context_prompts(spark, sf):
    h = _hits(spark, sf)
    return P.context_prompt(h, "query_id", "rank", P.context_entry(F.col("text"), F.col("source")), F.lit("General"), F.concat(F.lit("What is "), F.coalesce("title", F.lit(""))))


def citation_lists(spark, sf):
    return P.citations(_hits(spark, sf), "query_id", "rank", F.when(F.col("doc_id") % 3 == 0, F.col("title")), F.lower("source"))


def numbered_contexts(spark, sf):
    c = P.numbered_context(_hits(spark, sf), "query_id", "rank", F.col("text"))
    kind = P.pick_template({"GK-000001": "Short.\n{context}\n\n{question}"}, F.col("query_id"), default="{context}\n\nQuestion: {question}")
    return c.select("query_id", P.fill(kind, context=F.col("context"), question=F.col("query_id")).alias("prompt"))


QUERIES = {f.__name__: f for f in (keyphrases, keyphrases_hybrid, keyword_domains, content_purpose, prompt_type, keyword_density, tag_fusion, topk_cosine, topk_ip, topk_l2, hits_by_label, index_routing, incremental_rows, unseen_texts, text_neighbours, history_trim, conversation_headers, newest_conversations, message_json, context_prompts, citation_lists, numbered_contexts)}

_STOP = ", ".join(f"'{w}'" for w in C.STOP_WORDS)


def _phrases(name: str, text: str, least: str, top: int) -> str:
    return f"""{name}_w AS (SELECT doc_id, list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda x: regexp_matches(x, '^[a-z].')) AS w FROM documents WHERE length(coalesce({least}, '')) >= 10),
    {name}_g AS (SELECT doc_id, n, i AS pos, w[i:i + n - 1] AS g FROM {name}_w, unnest([1, 2, 3]) AS a(n), unnest(range(1, len(w) - n + 2)) AS b(i)),
    {name}_c AS (SELECT doc_id, n, array_to_string(g, ' ') AS phrase, round(count(*) * (1 + 0.2 * n), 6) AS score, min(pos) AS pos FROM {name}_g WHERE NOT list_has_any(g, [{_STOP}]) AND (n > 1 OR length(g[1]) > 3) GROUP BY 1, 2, 3),
    {name} AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n, pos))::INT AS rank, phrase, score::DOUBLE AS score FROM {name}_c QUALIFY rank <= {top})"""


def _scores(categories: dict) -> str:
    parts = []
    for i, (name, entries) in enumerate(categories.items()):
        total = " + ".join(f"CASE WHEN contains(lower(coalesce(title, '')), '{w}') THEN {2 * x} WHEN contains(lower(coalesce(text, '')), '{w}') THEN {x} ELSE 0.0 END" for w, x in C.weighted(entries))
        parts.append(f"SELECT doc_id, {i} AS ord, '{name}' AS category, ({total})::DOUBLE AS score FROM documents")
    return " UNION ALL ".join(parts)


def _topk(metric: str) -> str:
    s = {"cosine": "list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])", "ip": "list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])", "l2": "-pow(list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 2)"}[metric]
    return f"""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round({s}, 9) AS s FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, id) AS rank FROM s)"""


_ROLE = "CASE WHEN right(chunk_id, 2)::INT % 10 = 0 THEN 'system' WHEN right(chunk_id, 1)::INT % 2 = 0 THEN 'user' ELSE 'assistant' END"
_MSG = f"m AS (SELECT source AS conv_id, chunk_id AS turn, {_ROLE} AS role, content AS text, created_at FROM document_chunk)"
_HITS = "h AS (SELECT guide_key AS query_id, row_number() OVER (PARTITION BY guide_key ORDER BY loaded_at DESC, doc_id) AS rank, doc_id, title, text, source FROM documents WHERE guide_key IS NOT NULL QUALIFY rank <= 3)"


def _count(words: tuple[str, ...]) -> str:
    return " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in words)


def _prompt() -> str:
    parts = []
    for i, (name, patterns) in enumerate(C.PROMPT_TYPES.items()):
        parts.append(f"SELECT doc_id, {i} AS ord, '{name}' AS category, ({' + '.join(f'''CASE WHEN contains(lower(text), '{p}') THEN {w} ELSE 0.0 END''' for p, w in patterns)})::DOUBLE AS score FROM documents")
    return " UNION ALL ".join(parts)


_KEY = "coalesce(json_extract_string(metadata, '$.id'), json_extract_string(metadata, '$.source'), sha256(text))"
_TOK = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> ''))"

SQL = {
    "keyphrases": f"WITH {_phrases('k', "coalesce(nullif(title, '''') || chr(10) || chr(10), '''') || text".replace("''''", "''"), 'text', 10)} SELECT * FROM k",
    "keyphrases_hybrid": f"""WITH {_phrases('a', 'title', 'title', 3)}, {_phrases('b', 'text', 'text', 8)},
        u AS (SELECT *, 0 AS src FROM a UNION ALL SELECT *, 1 FROM b), o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, phrase ORDER BY src, rank) = 1),
        t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY src, rank, phrase) AS k FROM o QUALIFY k <= 8),
        s AS (SELECT doc_id, phrase, k, round(score / max(score) OVER (PARTITION BY doc_id), 6) AS score FROM t)
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k))::INT AS rank, phrase, score FROM s""",
    "keyword_domains": f"""WITH s AS ({_scores(DOMAINS)})
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) - 1)::INT AS idx, category, round(score, 6) AS score, round(score / max(score) OVER (PARTITION BY doc_id), 6) AS relative FROM s WHERE score > 0""",
    "content_purpose": rf"""WITH s AS ({_scores(PURPOSES)}), b AS (SELECT s.doc_id, ord, category, score + CASE WHEN category = 'how_to' AND regexp_matches(lower(text), 'step \d+|\d+\.\s') THEN 3 ELSE 0 END AS score FROM s JOIN documents USING (doc_id)),
        p AS (SELECT doc_id, category FROM b WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) = 1),
        d AS ({_scores(DOMAINS)}), g AS (SELECT doc_id, string_agg(category, ',' ORDER BY category) AS subdomains FROM d WHERE score > 0 AND (category = 'sourcing' OR starts_with(category, 'sourcing_')) GROUP BY 1)
        SELECT documents.doc_id, coalesce(p.category, 'unknown') AS purpose, coalesce(subdomains, '') AS subdomains FROM documents LEFT JOIN p USING (doc_id) LEFT JOIN g USING (doc_id)""",
    "prompt_type": rf"""WITH s AS ({_prompt()}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS k FROM s WHERE score > 0),
        b AS (SELECT doc_id, max(category) FILTER (WHERE k = 1) AS c, max(score) FILTER (WHERE k = 1) AS s, string_agg(category, ',' ORDER BY k) FILTER (WHERE k > 1) AS o FROM r GROUP BY 1)
        SELECT doc_id, coalesce(c, 'General') AS prompt_type, round(coalesce(s, 0), 6) AS confidence, coalesce(o, '') AS others,
        CASE {' '.join(f"WHEN regexp_matches(title, '{p}') THEN '{n}'" for n, p in C.QUERY_TYPES)} ELSE 'General' END AS query_type FROM documents LEFT JOIN b USING (doc_id)""",
    "keyword_density": f"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), n AS (SELECT doc_id, {_count(C.SOURCING)} AS a, {_count(C.PROCUREMENT)} AS b FROM d)
        SELECT doc_id, a AS sourcing, b AS procurement, CASE WHEN a > b THEN 'Sourcing' WHEN b > a THEN 'Procurement' ELSE 'General' END AS domain, CASE WHEN a = b THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM n""",
    "topk_cosine": _topk("cosine") + " SELECT query_id, rank::INT AS rank, id, round(s, 6) AS score, round(CASE WHEN round(s, 6) <= 2 THEN 1 - round(s, 6) / 2 ELSE 0 END, 6) AS compatible FROM r WHERE rank <= 5",
    "topk_ip": _topk("ip") + " SELECT query_id, rank::INT AS rank, id, round(s, 6) AS score FROM r WHERE rank <= 5",
    "topk_l2": _topk("l2") + " SELECT query_id, rank::INT AS rank, id, round(-s, 6) AS score FROM r WHERE rank <= 5",
    "hits_by_label": _topk("cosine") + """, l AS (SELECT query_id, rank::INT AS rank, id, label, coalesce(CASE WHEN label % 3 <> 0 THEN label END, CASE WHEN label % 6 <> 0 THEN label + 100 END) AS k FROM r JOIN embeddings e ON e.vec_id = r.id WHERE rank <= 10)
        SELECT query_id, rank, id, label FROM l QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY rank) = 1""",
    "index_routing": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'archive' WHEN lower(source) IN ('faq', 'marketing', 'product_doc') THEN lower(source) ELSE 'default' END AS index FROM documents",
    "incremental_rows": f"WITH k AS (SELECT {_KEY} AS key, loaded_at FROM pipeline_row) SELECT DISTINCT key FROM k WHERE key IS NOT NULL AND key NOT IN (SELECT key FROM k WHERE loaded_at < '2024-01-01' AND key IS NOT NULL)",
    "unseen_texts": "WITH k AS (SELECT sha256(content) AS sha, created_at FROM document_chunk) SELECT DISTINCT sha FROM k WHERE created_at >= '2024-01-01' AND sha IS NOT NULL AND sha NOT IN (SELECT sha FROM k WHERE created_at < '2024-01-01' AND sha IS NOT NULL)",
    "history_trim": f"""WITH {_MSG}, t AS (SELECT *, {_TOK} AS tokens, role = 'system' AS sys FROM m WHERE conv_id IS NOT NULL),
        w AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) AS total, sum(CASE WHEN sys THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS stok, sum(CASE WHEN sys THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS cum, max(CASE WHEN sys THEN turn END) OVER (PARTITION BY conv_id) AS lastsys FROM t)
        SELECT conv_id, turn, role, tokens FROM w WHERE total <= 300 OR (300 - stok > 0 AND (sys OR cum <= 300 - stok)) OR (300 - stok <= 0 AND turn = lastsys)""",
    "conversation_headers": f"""WITH {_MSG} SELECT conv_id, count(*) AS message_count, min(turn) AS first_turn, max(turn) AS last_turn, count(*) FILTER (WHERE role = 'user') AS user_count, coalesce(CASE WHEN count(*) > 1 THEN conv_id END, 'Empty conversation') AS summary FROM m GROUP BY conv_id""",
    "newest_conversations": f"WITH {_MSG} SELECT conv_id, max(created_at) AS updated_at FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20 OFFSET 5",
    "message_json": f"WITH {_MSG} SELECT turn, role, text AS content, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM m WHERE role IN ('system', 'user')",
    "context_prompts": f"""WITH {_HITS}, e AS (SELECT query_id, rank, title, '[Source](' || coalesce(source, '#') || ')' || chr(10) || CASE WHEN regexp_matches(text, '{P.HTML}') THEN regexp_replace(text, '<[^>]+>', '', 'g') ELSE text END AS x FROM h WHERE text <> '')
        SELECT query_id, 'Domain: General' || chr(10) || chr(10) || 'Question: What is ' || arg_min(coalesce(title, ''), rank) || chr(10) || chr(10) || chr(10) || chr(10) || 'Context:' || chr(10) || chr(10) || string_agg(x, chr(10) || chr(10) ORDER BY rank) AS prompt FROM e GROUP BY query_id""",
    "citation_lists": f"""WITH {_HITS}, n AS (SELECT query_id, rank, coalesce(CASE WHEN doc_id % 3 = 0 THEN nullif(title, '') END, nullif(lower(source), '')) AS name FROM h), f AS (SELECT query_id, name, min(rank) AS rank FROM n WHERE name IS NOT NULL GROUP BY 1, 2),
        g AS (SELECT query_id, string_agg('- ' || name, chr(10) ORDER BY rank) AS s FROM f GROUP BY 1)
        SELECT DISTINCT h.query_id, coalesce(chr(10) || '**Cited guides:**' || chr(10) || s, '') AS citations FROM h LEFT JOIN g USING (query_id)""",
    "numbered_contexts": f"""WITH {_HITS}, g AS (SELECT query_id, string_agg('[' || rank || '] ' || left(text, 2048), chr(10) || chr(10) ORDER BY rank) AS c FROM h GROUP BY 1)
        SELECT query_id, CASE WHEN query_id = 'GK-000001' THEN 'Short.' || chr(10) || c || chr(10) || chr(10) || query_id ELSE c || chr(10) || chr(10) || 'Question: ' || query_id END AS prompt FROM g""",
}
