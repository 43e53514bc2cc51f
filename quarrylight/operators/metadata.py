"""Metadata of documents: extraction rules, merging, validation, labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: keys that every document has, labels of kinds and purposes
CANONICAL = ("title", "source", "created_at", "updated_at", "authors", "tags", "content_type", "language")
TYPE_LABELS = {"guide": "📚 Guide", "tutorial": "🔍 Tutorial", "reference": "📖 Reference", "faq": "❓ FAQ"}
PURPOSE_LABELS = {"how_to": "Step-by-step guide", "explanation": "Concept explanation", "reference": "Reference material"}
LANGUAGE = r"^[a-z]{2}(-[A-Z]{2})?$"


@dataclass(frozen=True)
class Field:
    """A named field: its type (string, integer, float, boolean, datetime), whether it must be there, and a pattern."""

    name: str
    kind: str = "string"
    required: bool = False
    pattern: str | None = None


_CASTS = {"string": "string", "integer": "bigint", "float": "double", "boolean": "boolean", "datetime": "timestamp"}


def extract(rules: list[Column], default=None) -> Column:
    """The first rule that gives something, else the default."""
    return F.coalesce(*rules, F.lit(default))


def merge(existing: Column, extracted: Column) -> Column:
    """What is there already, else what was extracted."""
    return F.coalesce(existing, extracted)


def canonical(df: DataFrame, keys: tuple[str, ...] = CANONICAL) -> DataFrame:
    """All canonical keys as columns, null where there was none."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({k: F.lit(None).cast("string") for k in keys if k not in have})


def problems(values: dict[str, Column], schema: list[Field]) -> Column:
    """What is wrong with string values under a schema: missing, type or pattern of a field, in the schema's order."""
    out = []
    for f in schema:
        v = values.get(f.name, F.lit(None).cast("string"))
        if f.required:
            out.append(F.when(v.isNull(), f"{f.name}: missing"))
        out.append(F.when(v.isNotNull() & v.try_cast(_CASTS[f.kind]).isNull(), f"{f.name}: not a {f.kind}"))
        if f.pattern:
            out.append(F.when(~v.rlike(f.pattern), f"{f.name}: pattern"))
    return F.array_compact(F.array(*out))


def normalized(value: Column) -> Column:
    """Lists as lists of strings and everything else as JSON text without nulls."""
    return F.to_json(value, {"ignoreNullFields": "true"})


def relevance(score: Column, threshold: float = 0.2) -> Column:
    """high above twice the threshold, medium above it, else low; null for null."""
    return F.when(score.isNull(), None).when(score > 2 * threshold, "high").when(score > threshold, "medium").otherwise("low")


def label(value: Column, labels: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), value)


def path_context(path: Column) -> Column:
    """File name, stem and extension of a path."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.struct(name.alias("file_name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("extension"))


def combine(separator: str, *fields: Column) -> Column:
    """Fields that have a value, joined."""
    return F.concat_ws(separator, *[F.nullif(f.cast("string"), F.lit("")) for f in fields])


def purpose_by_pattern(text: Column, patterns: dict[str, list[str]], default: str | None = None) -> Column:
    """The first purpose one of whose patterns occurs."""
    found = [F.when(sum((F.regexp_count(text, F.lit(p)) for p in ps[1:]), F.regexp_count(text, F.lit(ps[0]))) > 0, name) for name, ps in patterns.items()]
    return F.coalesce(*found, F.lit(default).cast("string"))


def as_text(title: Column, kind: Column, purpose: Column, source: Column, authors: Column, created: Column, updated: Column) -> Column:
    """Metadata as lines for a prompt, without what is missing."""
    date = F.coalesce(F.concat(F.lit("Created: "), created.cast("string")), F.concat(F.lit("Updated: "), updated.cast("string")))
    lines = [F.concat(F.lit("Title: "), title), label(kind, TYPE_LABELS), label(purpose, PURPOSE_LABELS), F.concat(F.lit("Source: "), source), F.concat(F.lit("Author: "), F.nullif(F.array_join(authors, ", "), F.lit(""))), date]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


@dataclass(frozen=True)
class MapField:
    """A field under another name too."""

    source: str
    target: str


@dataclass(frozen=True)
class CombineFields:
    """Fields that have a value, joined."""

    sources: tuple[str, ...]
    target: str
    separator: str = " "


@dataclass(frozen=True)
class ExtractJson:
    """What a field of JSON text holds at a path of names and dots."""

    source: str
    target: str
    path: str


def _without(values: Column, name: str) -> Column:
    return F.map_filter(values, lambda k, _: k != name)


def apply_rules(values: Column, rules: list[MapField | CombineFields | ExtractJson]) -> Column:
    """A map of strings after the rules, one after the other; a rule without a result changes nothing, a null map stays null."""

    def held(name: str) -> Column:
        return F.nullif(F.try_element_at(values, F.lit(name)), F.lit(""))

    for r in rules:
        if isinstance(r, MapField):
            found = F.try_element_at(values, F.lit(r.source))
        elif isinstance(r, CombineFields):
            found = F.nullif(F.concat_ws(r.separator, *[held(s) for s in r.sources]), F.lit(""))
        else:
            found = F.try_variant_get(F.try_parse_json(held(r.source)), f"$.{r.path}", "string")
        values = F.when(found.isNotNull(), F.map_concat(_without(values, r.target), F.create_map(F.lit(r.target), found))).otherwise(values)
    return values


def extract_schemas(schemas: list[dict[str, list[Column]]]) -> dict[str, Column]:
    """One column per field of schemas in their order (core, content, then special ones): the first rule of the first schema that gives something."""
    rules: dict[str, list[Column]] = {}
    for schema in schemas:
        for name, own in schema.items():
            rules.setdefault(name, []).extend(own)
    return {name: F.coalesce(*own) for name, own in rules.items()}


def table_text(df: DataFrame, sheet: str | None = None, most_rows: int = 100, most_columns: int = 20) -> str:
    """A table as text for people: its columns and number of rows, then the first rows; a notice for an empty one."""
    n = df.count()
    if not n:
        return f"Sheet '{sheet or 'Unknown'}' is empty."
    head = [f"Sheet: {sheet}"] if sheet else []
    head += [f"Columns: {', '.join(df.columns)}", f"Rows: {n}"]
    shown = df.limit(most_rows).toPandas().to_string(index=False, max_rows=most_rows, max_cols=most_columns)
    note = f"\n\n[Note: Showing first {most_rows} rows out of {n} total rows]" if n > most_rows else ""
    return "\n".join(head) + "\n\n" + shown + note
