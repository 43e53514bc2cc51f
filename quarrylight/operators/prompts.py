"""Context, citations and prompts from ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import HTML

NO_CONTEXT = "No relevant context found."


def ordered(hits: DataFrame, query: str, rank: str, item: Column) -> DataFrame:
    """Per query its items as an array in the order of their ranks; null items are left out."""
    return hits.groupBy(query).agg(F.sort_array(F.collect_list(F.when(item.isNotNull(), F.struct(F.col(rank).alias("r"), item.alias("x"))))).alias("_s")).select(query, F.col("_s.x").alias("items"))


def context_entry(content: Column, url: Column, images: Column | None = None) -> Column:
    """One document of a context: lines for its images, then its source and text without tags. Null without any."""
    text = F.when(content.rlike(HTML), F.regexp_replace(content, "<[^>]+>", "")).otherwise(content)
    body = F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit("[Source]("), F.coalesce(url, F.lit("#")), F.lit(")\n"), text))
    if images is None:
        return body
    shown = F.transform(F.coalesce(images, F.array().cast("array<string>")), lambda p: F.concat(F.lit("!["), F.regexp_extract(p, r"([^/]*)$", 1), F.lit("]("), p, F.lit(")")))
    return F.nullif(F.array_join(F.array_compact(F.concat(shown, F.array(body))), "\n\n"), F.lit(""))


def context_prompt(hits: DataFrame, query: str, rank: str, entry: Column, domain: Column, question: Column) -> DataFrame:
    """Per query the prompt's head and its documents in order, apart by empty lines."""
    head = hits.groupBy(query).agg(F.min_by(domain, rank).alias("_d"), F.min_by(question, rank).alias("_q"))
    parts = head.join(ordered(hits, query, rank, entry), query)
    lead = F.array(F.concat(F.lit("Domain: "), F.col("_d")), F.concat(F.lit("Question: "), F.col("_q")), F.lit(""), F.lit("Context:"))
    return parts.select(query, F.array_join(F.concat(lead, "items"), "\n\n").alias("prompt"))


def citations(hits: DataFrame, query: str, rank: str, *names: Column) -> DataFrame:
    """Per query the names of what is cited, each once in the order of first use; an empty text if nothing has a name."""
    name = F.coalesce(*[F.nullif(n.cast("string"), F.lit("")) for n in names])
    once = ordered(hits, query, rank, name).withColumn("items", F.array_distinct("items"))
    lines = F.array_join(F.transform("items", lambda n: F.concat(F.lit("- "), n)), "\n")
    return once.select(query, F.when(F.size("items") > 0, F.concat(F.lit("\n**Cited guides:**\n"), lines)).otherwise("").alias("citations"))


def numbered_context(hits: DataFrame, query: str, rank: str, content: Column, most: int = 2048) -> DataFrame:
    """Per query its documents numbered from 1, each cut to ``most`` characters; a notice if there are none."""
    parts = ordered(hits, query, rank, F.coalesce(content, F.lit("")))
    text = F.array_join(F.transform("items", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.left(x, F.lit(most)))), "\n\n")
    return parts.select(query, F.when(F.size("items") > 0, text).otherwise(NO_CONTEXT).alias("context"))


def fill(template: str | Column, **values: Column) -> Column:
    """A template with {name} places filled; unknown places stay, nulls become empty."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def pick_template(templates: dict[str, str], *keys: Column, default: str = "") -> Column:
    """The template of the first key there is one for."""
    table = F.create_map(*[F.lit(x) for kv in templates.items() for x in kv])
    return F.coalesce(*[F.try_element_at(table, k) for k in keys], F.lit(default))


def sendable(messages: DataFrame, roles: tuple[str, ...] = ("system", "user", "assistant")) -> DataFrame:
    return messages.where(F.col("role").isin(*roles))


def extract_answer(hits: DataFrame, query: str, rank: str, content: Column, sentences: int = 2) -> DataFrame:
    """Per query the first sentences of its best hit that has text: the answer where no model is at hand; empty without any."""
    text = F.when(content.rlike(HTML), F.regexp_replace(content, "<[^>]+>", "")).otherwise(content)
    has = F.coalesce(F.trim(text), F.lit("")) != ""
    best = hits.groupBy(query).agg(F.min_by(F.when(has, text), F.when(has, F.col(rank))).alias("_t"))
    first = F.array_join(F.slice(F.filter(F.split("_t", r"(?<=[.!?])\s+"), lambda x: x != ""), 1, sentences), " ")
    return best.select(query, F.coalesce(first, F.lit("")).alias("answer"))


def response(answer: Column, cited: Column) -> Column:
    """An answer with its citations below, if there are any."""
    return F.when(F.coalesce(cited, F.lit("")) != "", F.concat(answer, F.lit("\n\n"), cited)).otherwise(answer)


def answer_queries(hits: DataFrame, query: str, rank: str, question: Column, domain: Column, content: Column, url: Column, *names: Column, most: int = 2048) -> DataFrame:
    """Per query of ranked hits with their documents: prompt, answer, citations and the response made of both."""
    prompt = context_prompt(hits, query, rank, context_entry(F.left(content, F.lit(most)), url), domain, question)
    parts = prompt.join(extract_answer(hits, query, rank, content), query).join(citations(hits, query, rank, *names), query)
    return parts.select(query, "prompt", "answer", "citations", response(F.col("answer"), F.col("citations")).alias("response"))
