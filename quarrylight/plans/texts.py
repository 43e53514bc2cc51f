"""Queries on plain text, markdown and HTML: cleaning, patterns, chunks, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import html as H
from quarrylight.functions import text as T
from quarrylight.operators import chunking
from quarrylight.plans.relations import table

#: White space in DuckDB's patterns, which know only that of ASCII.
_S = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_W = r"[\p{L}\p{N}\p{M}_]"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "page_export").select(F.col("id").alias("page_id"), "link", "title", "content")


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a heading of rank 1 in front, and every paragraph that a heading of rank 3 leads in promoted."""
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.regexp_replace("text", r"(?dm)^### ", "# ")).alias("text"))


_MD = r"(SELECT doc_id, '# ' || title || chr(10) || chr(10) || regexp_replace(text, '(?m)^### ', '# ', 'g') AS text FROM documents)"


def text_normalize(spark, sf):
    c = F.col("text")
    return documents(spark, sf).select("doc_id", T.clean_text(c).alias("cleaned"), T.normalize_newlines(c).alias("lines"), T.clean_text(c, max_length=80).alias("short"), T.as_string(T.clean_text(c, whitespace=False)).alias("kept"))


def token_count(spark, sf):
    c = F.col("text")
    return documents(spark, sf).select("doc_id", T.count_tokens(c).alias("n_words"), F.size(T.tokens(c)).cast("bigint").alias("n_tokens"), T.count_tokens(c, "char").alias("n_estimated"))


def sentences(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("idx", "sentence"))


def content_types(spark, sf):
    both = documents(spark, sf).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    both = both.unionByName(pages(spark, sf).select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("content").alias("text")))
    return both.select("kind", "id", T.content_type(F.col("text")).alias("content_type"))


def markdown_outline(spark, sf):
    rows = markdown(spark, sf).select("doc_id", F.posexplode(T.outline(F.col("text"))).alias("idx", "h"))
    return rows.select("doc_id", "idx", F.col("h.level").alias("level"), F.col("h.text").alias("heading"))


def markdown_clean(spark, sf):
    c = F.concat(F.col("text"), F.lit("\n```sql\nSELECT 1\n```\n`id` and *all*"))
    return markdown(spark, sf).select("doc_id", T.clean_markdown(c).alias("no_code"), T.strip_markdown(c).alias("no_marks"), T.first_heading(c).alias("heading"), F.array_join(T.code_languages(c), ",").alias("languages"), F.array_join(T.code_blocks(c), "|").alias("code"))


def text_flags(spark, sf):
    c = F.col("text")
    return documents(spark, sf).select(
        "doc_id", c.rlike(T.PDF_MARKER).alias("page_marker"), c.rlike(T.VIDEO).alias("video"), F.size(T.list_items(c)).cast("bigint").alias("n_list_items"),
        c.rlike(r"(?dm)^(#+|\*\*?|\d+\.)\s+").alias("headed"), F.size(T.markdown_images(c)).cast("bigint").alias("n_images"), F.size(T.markdown_links(c)).cast("bigint").alias("n_links"),
        *[T.field_line(c, n).alias(n) for n in T.FIELDS], T.contains_word(F.lower(c), "supplier").alias("says_supplier"),
    )


def word_chunks(spark, sf):
    return chunking.word_chunks(documents(spark, sf), size=100, overlap=20).drop("text")


def token_windows(spark, sf):
    return chunking.token_windows(documents(spark, sf), size=120, overlap=30).drop("text")


def header_chunks(spark, sf):
    return chunking.header_chunks(markdown(spark, sf)).drop("text")


def typed_chunks(spark, sf):
    rows = pages(spark, sf).select("page_id", H.html_text(F.col("content")).alias("text"), T.content_type(F.col("content")).alias("kind"))
    return chunking.typed_chunks(rows, size=200, overlap=50).select("page_id", "kind", "chunk_type", "chunk_index", "token_count", "start_word_idx", "end_word_idx", "chunk")


def html_text(spark, sf):
    c = F.col("content")
    return pages(spark, sf).select("page_id", H.html_text(c).alias("text"), H.html_text(c, ("nav", "footer")).alias("body"), H.html_strings(c).alias("strings"))


def html_titles(spark, sf):
    return pages(spark, sf).select("page_id", H.title(F.col("content"), "No Title Found").alias("title"), H.slug(F.col("link")).alias("slug"), F.size(H.images(F.col("content"))).cast("bigint").alias("n_images"), F.size(F.map_keys(H.meta(F.col("content")))).cast("bigint").alias("n_meta"))


def html_links(spark, sf):
    rows = pages(spark, sf).select("page_id", F.posexplode(H.links(F.col("content"))).alias("idx", "x"))
    return rows.select("page_id", "idx", "x.href", "x.anchor")


def html_headings(spark, sf):
    rows = pages(spark, sf).select("page_id", F.posexplode(H.headings(F.col("content"))).alias("idx", "x"))
    return rows.select("page_id", "idx", "x.level", F.col("x.text").alias("heading"))


def html_export(spark, sf):
    style = "<style>body{margin:2em}</style>"
    return pages(spark, sf).select("page_id", F.format_string("%04d.html", "page_id").alias("file_name"), H.export_page(F.col("title"), F.col("content"), style).alias("html"), H.clean_fragment(F.col("content")).alias("fragment"))


def text_export(spark, sf):
    return documents(spark, sf).select("doc_id", H.paragraphs(F.col("text")).alias("html"), T.safe_name(T.truncate(F.col("text"), 60)).alias("file_name"))


QUERIES = {f.__name__: f for f in (text_normalize, token_count, sentences, content_types, markdown_outline, markdown_clean, text_flags, word_chunks, token_windows, header_chunks, typed_chunks, html_text, html_titles, html_links, html_headings, html_export, text_export)}

_WORDS = f"list_filter(regexp_split_to_array(text, '{_S}+'), lambda x: x <> '')"
_TOKENS = rf"regexp_extract_all(text, '{_W}+|[^\p{{L}}\p{{N}}\p{{M}}_\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"



def _chain(c: str, tags: tuple[str, ...] = ("script", "style", "template")) -> str:
    for t in tags:
        c = rf"regexp_replace({c}, '(?is)<{t}\b.*?</{t}\s*>', '', 'g')"
    return rf"regexp_replace({c}, '(?s)<!--.*?-->', '', 'g')"


def _decoded(c: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = f"replace({c}, '{name}', '{char}')"
    return c


def _visible(tags: tuple[str, ...]) -> str:
    return f"trim(regexp_replace({_decoded(f'''regexp_replace({_chain('content', tags)}, '<[^>]*>', ' ', 'g')''')}, '{_S}+', ' ', 'g'))"


def _kind(x: str) -> str:
    md = " OR ".join(f"regexp_matches({x}, '{p}')" for p in (T.MD_HEADING, T.MD_LIST, T.MD_CODE))
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN regexp_matches({x}, '{T.HTML}') THEN 'html' WHEN {md} THEN 'markdown' ELSE 'text' END"


_TAIL = r" || chr(10) || '```sql' || chr(10) || 'SELECT 1' || chr(10) || '```' || chr(10) || '`id` and *all*'"
_WINDOW = "unnest(range(0, len(w), {step})) AS u(s)"

SQL = {
    "text_normalize": rf"""SELECT doc_id, trim(regexp_replace(text, '{_S}+', ' ', 'g')) AS cleaned, {_strip(rf"regexp_replace(text, '\n{_S}*', chr(10), 'g')")} AS lines,
        left(trim(regexp_replace(text, '{_S}+', ' ', 'g')), 80) AS short, coalesce(regexp_replace(text, '\n{{2,}}', chr(10) || chr(10), 'g'), '') AS kept FROM documents""",
    "token_count": f"SELECT doc_id, len({_WORDS}) AS n_words, len({_TOKENS}) AS n_tokens, length(text) // 4 AS n_estimated FROM documents",
    "sentences": rf"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?]){_S}+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents)
        SELECT doc_id, (i - 1)::INT AS idx, s[i] AS sentence FROM s, unnest(range(1, len(s) + 1)) AS u(i)""",
    "content_types": f"SELECT 'document' AS kind, doc_id AS id, {_kind('text')} AS content_type FROM documents UNION ALL SELECT 'page', id, {_kind('content')} FROM page_export",
    "markdown_outline": rf"""WITH m AS (SELECT doc_id, regexp_extract_all(text, '(?m)^(#{{1,6}})\s+(.+)$', 1) AS l, regexp_extract_all(text, '(?m)^(#{{1,6}})\s+(.+)$', 2) AS t FROM {_MD})
        SELECT doc_id, (i - 1)::INT AS idx, length(l[i])::INT AS level, t[i] AS heading FROM m, unnest(range(1, len(l) + 1)) AS u(i)""",
    "markdown_clean": rf"""WITH m AS (SELECT doc_id, text{_TAIL} AS c FROM {_MD})
        SELECT doc_id, regexp_replace(regexp_replace(c, '(?s)```.*?```', '', 'g'), '`([^`]+)`', '\1', 'g') AS no_code,
        regexp_replace(regexp_replace(regexp_replace(c, '(?m)^#{{1,6}}\s+', '', 'g'), '[*_]{{1,2}}([^*_]+)[*_]{{1,2}}', '\1', 'g'), '`([^`]+)`', '\1', 'g') AS no_marks,
        nullif(regexp_extract(c, '(?m)^#\s+(.+)$', 1), '') AS heading, array_to_string(regexp_extract_all(c, '```(\w+)', 1), ',') AS languages,
        array_to_string(regexp_extract_all(c, '(?s)```(?:\w+)?\n(.*?)```', 1), '|') AS code FROM m""",
    "text_flags": rf"""SELECT doc_id, regexp_matches(text, '{T.PDF_MARKER}') AS page_marker, regexp_matches(text, '{T.VIDEO}') AS video,
        len(regexp_extract_all(text, '(?m)^(?:[*\-+]|\d+\.)\s+(.+)$', 1)) AS n_list_items, regexp_matches(text, '(?m)^(#+|\*\*?|\d+\.)\s+') AS headed,
        len(regexp_extract_all(text, '!\[[^\]]*\]\(([^)]+)\)', 1)) AS n_images, len(regexp_extract_all(text, '\[([^\]]+)\]\(([^)]+)\)', 1)) AS n_links,
        {", ".join(rf"nullif(regexp_extract(text, '(?:{v}):\s*(.+)(?:\n|$)', 1), '') AS {k}" for k, v in (("title", "Title|TITLE"), ("author", "Author|AUTHOR"), ("date", "Date|DATE"), ("subject", "Subject|SUBJECT")))},
        regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}\p{{M}}_])supplier($|[^\p{{L}}\p{{N}}\p{{M}}_])') AS says_supplier FROM documents""",
    "word_chunks": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents)
        SELECT doc_id, (s // 80)::INT AS chunk_index, array_to_string(w[s + 1:s + 100], ' ') AS chunk, least(100, len(w) - s)::INT AS token_count, s::INT AS start_word_idx, least(s + 100, len(w))::INT AS end_word_idx
        FROM d, {_WINDOW.format(step=80)}""",
    "token_windows": f"""WITH d AS (SELECT doc_id, text, {_TOKENS} AS w FROM documents)
        SELECT doc_id, (s // 90)::INT AS chunk_index, CASE WHEN len(w) <= 120 THEN {_strip("text")} ELSE array_to_string(w[s + 1:s + 120], ' ') END AS chunk
        FROM d, {_WINDOW.format(step=90)} WHERE s = 0 OR s - 90 + 120 < len(w)""",
    "header_chunks": rf"""WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '(?m)^(# .+)$', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: {_strip("x")}), lambda x: x <> '') AS p FROM {_MD} WHERE regexp_matches(text, '(?m)^# .+$'))
        SELECT doc_id, (i - 1)::INT AS chunk_index, p[i] AS chunk FROM d, unnest(range(1, len(p) + 1)) AS u(i)""",
    "typed_chunks": f"""WITH p AS (SELECT id AS page_id, {_kind("content")} AS kind, {_visible(("script", "style", "template"))} AS text FROM page_export),
        d AS (SELECT page_id, kind, {_kind("text")} AS chunk_type, {_WORDS} AS w FROM p)
        SELECT page_id, kind, chunk_type, (s // 150)::INT AS chunk_index, least(200, len(w) - s)::INT AS token_count, s::INT AS start_word_idx, least(s + 200, len(w))::INT AS end_word_idx, array_to_string(w[s + 1:s + 200], ' ') AS chunk
        FROM d, {_WINDOW.format(step=150)}""",
    "html_text": f"""SELECT id AS page_id, {_visible(("script", "style", "template"))} AS text, {_visible(("script", "style", "template", "nav", "footer"))} AS body,
        array_to_string(list_filter(list_transform(regexp_split_to_array({_chain("content", ("script", "style", "nav", "footer"))}, '<[^>]*>'), lambda s: {_strip(_decoded("s"))}), lambda s: s <> ''), ' ') AS strings FROM page_export""",
    "html_titles": r"""SELECT id AS page_id, coalesce(nullif(regexp_extract(content, '(?i)<title>([^<]+)</title>', 1), ''), 'No Title Found') AS title,
        CASE WHEN link IS NOT NULL THEN coalesce(nullif(replace(regexp_replace(regexp_extract(link, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/', '_'), ''), 'index') END AS slug,
        len(regexp_extract_all(content, '(?i)<img\s+[^>]*src=["'']([^"'']+)["'']', 1)) AS n_images, len(list_distinct(regexp_extract_all(content, '(?i)<meta\s+name="([^"]+)"\s+content="([^"]*)"', 1))) AS n_meta FROM page_export""",
    "html_links": r"""WITH p AS (SELECT id AS page_id, regexp_extract_all(content, '(?i)<a\s+[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(content, '(?i)<a\s+[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 2) AS a FROM page_export)
        SELECT page_id, (i - 1)::INT AS idx, h[i] AS href, a[i] AS anchor FROM p, unnest(range(1, len(h) + 1)) AS u(i)""",
    "html_headings": rf"""WITH p AS (SELECT id AS page_id, regexp_extract_all(content, '(?i){"|".join(f"<h{n}[^>]*>[^<]+</h{n}>" for n in range(1, 7))}') AS h FROM page_export)
        SELECT page_id, (i - 1)::INT AS idx, h[i][3]::INT AS level, regexp_extract(h[i], '>([^<]+)<', 1) AS heading FROM p, unnest(range(1, len(h) + 1)) AS u(i)""",
    "html_export": rf"""WITH p AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(content, '(?is)<style\b.*?</style\s*>', '', 'g'), '(?is)<script\b.*?</script\s*>', '', 'g'), '(?i)\s+style=(?:"[^"]*"|''[^'']*'')', '', 'g') AS f FROM page_export)
        SELECT id AS page_id, printf('%04d.html', id) AS file_name, '<style>body{{margin:2em}}</style><h1>' || coalesce(title, '') || '</h1>' || chr(10) || coalesce(content, '') AS html,
        CASE WHEN regexp_matches(f, '(?i)^\s*<!doctype') THEN '' ELSE '<!DOCTYPE html>' || chr(10) END || CASE WHEN regexp_matches(f, '(?i)<meta[^>]*charset') THEN '' ELSE '<meta charset="utf-8">' || chr(10) END || f AS fragment FROM p""",
    "text_export": rf"""SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10) || chr(10)), lambda p: '<p>' || p || '</p>'), chr(10)) AS html,
        regexp_replace(left(text, 60), '[^\p{{L}}\p{{N}}\p{{M}}_.\-{_S[1:]}', '', 'g') AS file_name FROM documents""",
}
