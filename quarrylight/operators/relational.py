"""Related tables to documents: nesting children, owners, bridges, and text from rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# fixed values: parts of the names of columns that hold files
FILE_WORDS = ("image", "file", "path", "asset", "doc", "attachment")


@dataclass(frozen=True)
class Relationship:
    """A parent and a child entity with the keys that relate them."""

    parent: str
    child: str
    parent_key: str
    child_key: str
    kind: str = "one_to_many"


def clean_column(name: str) -> str:
    """A sheet's column name: without angle brackets, the part after the last bar."""
    return re.sub(r"^<|>$", "", name.strip()).split("|")[-1].strip()


def clean_columns(df: DataFrame) -> DataFrame:
    """Columns under their clean names; a name that clashes gets a number behind it."""
    seen: dict[str, int] = {}
    names = []
    for c in map(clean_column, df.columns):
        n = seen[c] = seen.get(c, 0) + 1
        names.append(c if n == 1 else f"{c}_{n}")
    return df.toDF(*names)


def entity_of(sheet: str, mapping: dict[str, str]) -> str:
    """The entity of a sheet: the mapping's exact name, an entity's own name, the first fitting "regex:" entry, else the sheet."""
    if sheet in mapping:
        return mapping[sheet]
    if sheet in mapping.values():
        return sheet
    return next((v for k, v in mapping.items() if k.startswith("regex:") and re.search(k[6:], sheet)), sheet)


def roots(entities: list[str], relationships: list[Relationship]) -> list[str]:
    """Entities that are nobody's child; all if every one is."""
    children = {r.child for r in relationships if r.child != r.parent}
    return [e for e in entities if e not in children] or list(entities)


def first_rows(df: DataFrame, key: str, order: str, limit: int | None = None) -> DataFrame:
    """One row per key, the first by ``order``, and at most ``limit`` of them; rows without a key stay apart by their order."""
    own = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("row "), F.col(order).cast("string")))
    once = df.withColumn("_k", F.row_number().over(Window.partitionBy(own).orderBy(order))).where(F.col("_k") == 1).drop("_k")
    return once.orderBy(order).limit(limit) if limit else once


def first_owner(pairs: DataFrame, child: str, *order: str) -> DataFrame:
    """Of all parents that reach a child the first by ``order`` keeps it."""
    return pairs.withColumn("_k", F.row_number().over(Window.partitionBy(child).orderBy(*order))).where(F.col("_k") == 1).drop("_k")


def nest(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, item: Column, out: str = "children") -> DataFrame:
    """Parents with the sorted array of their children's ``item``: empty without children, null where the parent has no key."""
    grouped = children.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_key")).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    met = parents.join(grouped, F.col(parent_key) == F.col("_key"), "left")
    none = F.array().cast(grouped.schema["_items"].dataType)
    return met.withColumn(out, F.when(F.col(parent_key).isNotNull(), F.coalesce("_items", none))).drop("_key", "_items")


def bridge(left: DataFrame, key: str, links: DataFrame, right: DataFrame, link_left: str, link_right: str, right_key: str, *names: str) -> DataFrame:
    """Per left key the sorted distinct values of ``names`` of what it is linked to; keys without any have an empty array."""
    one = links.select(F.col(link_left).alias("_l"), F.col(link_right).alias("_r")).distinct()
    met = one.join(right.select(F.col(right_key).alias("_r"), F.explode(F.array(*[F.col(n).cast("string") for n in names])).alias("_n")), "_r").where(F.col("_n").isNotNull())
    grouped = met.groupBy("_l").agg(F.array_sort(F.collect_set("_n")).alias("names"))
    return left.select(key).join(grouped, F.col(key) == F.col("_l"), "left").select(key, F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def related(df: DataFrame, other: DataFrame, left: str, right: str, kind: str) -> DataFrame:
    """Rows with their partner under one of the declared kinds; a one_to_one or many_to_one keeps one partner, the smallest."""
    if kind not in ("one_to_many", "many_to_one", "one_to_one", "many_to_many"):
        raise ValueError(f"unknown kind {kind!r}")
    side = other.select(F.col(right).alias("_k"), F.struct(*other.columns).alias("partner")).where(F.col("_k").isNotNull())
    if kind in ("many_to_one", "one_to_one"):
        side = side.groupBy("_k").agg(F.min("partner").alias("partner"))
    return df.join(side, F.col(left) == F.col("_k"), "left").drop("_k")


def row_lines(sheet: str, number: Column, columns: list[str], most: int = 500) -> Column:
    """A row as text: sheet, number, and a line for each column that has a value, long ones cut."""

    def shown(c: str) -> Column:
        v = F.col(c).cast("string")
        return F.when(v.isNotNull(), F.concat(F.lit(f"{c}: "), F.when(F.length(v) > most, F.concat(F.left(v, F.lit(most)), F.lit("..."))).otherwise(v)))

    head = [F.lit(f"Sheet: {sheet}"), F.concat(F.lit("Row: "), number.cast("string"))]
    return F.array_join(F.array_compact(F.array(*head, *[shown(c) for c in columns])), "\n")


def entity_text(title: Column, content: Column, details: list[str], keep_order: bool = True) -> Column:
    """A row as markdown: title, its content (a JSON cell's text, else its content, else itself), and a table of details.

    Details come in the given order, or sorted by name and without empty values.
    """
    body = F.coalesce(json_at(content, "$.text"), json_at(content, "$.content"), content)
    cells = []
    for c in details if keep_order else sorted(details):
        v = F.col(c).cast("string")
        row = F.concat(F.lit(f"| {c} | "), F.coalesce(v, F.lit("")), F.lit(" |"))
        cells.append(row if keep_order else F.when(F.coalesce(v, F.lit("")) != "", row))
    table = F.concat(F.lit("## Details\n\n| Field | Value |\n| --- | --- |\n"), F.array_join(F.array_compact(F.array(*cells)), "\n"))
    return F.array_join(F.array_compact(F.array(F.concat(F.lit("# "), title), F.nullif(body, F.lit("")), table)), "\n\n")


def template_text(template: str, columns: list[str]) -> Column:
    """A template with {name} or {name|default}: an empty, missing or "nan" value gives the default, or nothing."""
    parts = []
    for i, piece in enumerate(re.split(r"\{([^{}]*)\}", template)):
        if i % 2 == 0:
            parts.append(F.lit(piece))
            continue
        name, _, default = piece.partition("|")
        value = F.col(name).cast("string") if name in columns else F.lit(None).cast("string")
        parts.append(F.when(F.coalesce(F.lower(value), F.lit("")).isin("", "nan"), default).otherwise(value))
    return F.concat(*parts)


def summary(columns: list[str]) -> Column:
    """The first of name, title, subject and description that has a value, else the first three columns as "name: value"."""
    named = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("name", "title", "subject", "description") if c in columns]
    some = F.array_join(F.slice(F.array_compact(F.array(*[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in columns])), 1, 3), ", ")
    return F.coalesce(*named, some)


def structured_text(columns: list[str], title: str | None = None, exclude: tuple[str, ...] = ()) -> Column:
    """Lines "name: value" in order, without empty values, below an optional title."""
    lines = [F.when(~F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0", "0.0", "false"), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns if c not in exclude]
    head = [F.lit(title)] if title else []
    return F.array_join(F.array_compact(F.array(*head, *lines)), "\n")


def row_id(prefix: str, stem: str, *ids: Column) -> Column:
    """An id that stays the same from run to run."""
    return F.concat_ws("_", F.lit(prefix), F.lit(stem), *[i.cast("string") for i in ids])


def asset_columns(columns: list[str]) -> list[str]:
    """Columns whose name tells that they hold files."""
    return [c for c in columns if any(word in c.lower() for word in FILE_WORDS)]


def assets(columns: list[str]) -> Column:
    """Values of the columns that hold files, without nulls and empty ones."""
    found = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in asset_columns(columns)]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def json_at(cell: Column, path: str) -> Column:
    """What stands at a path of a cell that is valid JSON, as text; null otherwise."""
    return F.try_variant_get(F.try_parse_json(cell), path, "string")


def json_asset(cell: Column, path: str | None = None) -> Column:
    """The file that a JSON cell names: at a path, there under path or id, else under path, url, file or image; a cell that is no object names itself."""
    if path:
        at = f"$.{path}"
        own = json_at(cell, at)
        return F.coalesce(json_at(cell, f"{at}.path"), json_at(cell, f"{at}.id"), F.when(~own.startswith("{"), own))
    found = [json_at(cell, f"$.{k}") for k in ("path", "url", "file", "image")]
    return F.coalesce(*found, F.when(~F.trim(cell).startswith("{"), cell))


def cells(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """All cells that have a value, row by row: order, pos (from 0), cell."""
    rows = df.select(order, F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("pos", "cell"))
    return rows.where(F.col("cell").isNotNull())


def field_value(c: Column, most: int = 500) -> Column:
    """A value as shown: nothing for null, JSON for lists, maps and structs, long ones cut."""
    text = c.cast("string")
    return F.coalesce(F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text), F.lit(""))


def as_json(df: DataFrame, columns: list[str]) -> Column:
    """A row's columns as one JSON text, nulls included; ``from_json`` with the same columns brings them back."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def from_json_row(c: Column, like: DataFrame, columns: list[str]) -> Column:
    return F.from_json(c, like.select(*columns).schema)


def assemble(entity: str, source: str, parents: DataFrame, key: str, text: Column, children: dict[str, tuple[DataFrame, Relationship, str]], metadata: tuple[str, ...] = (), files: Column | None = None) -> DataFrame:
    """Entities as documents: id, text, metadata (map), structured (JSON), assets.

    ``structured`` holds the entity's own row and, for each child entity (its rows, relationship and primary key), the kind of
    the relationship and the ids and rows of its children in order; a child that several parents reach belongs to the first.
    A parent without a key has no relationships. One row per parent key; a parent of very many children gives a very large
    row, as that is its result.
    """
    base = F.create_map(F.lit("source"), F.lit(source), F.lit("source_type"), F.lit("relational_data"), F.lit("entity_name"), F.lit(entity), F.lit("entity_id"), F.col(key).cast("string"))
    more = [F.when(F.col(m).isNotNull(), F.create_map(F.lit(m), F.col(m).cast("string"))).otherwise(F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))) for m in metadata]
    own = F.struct(F.lit(entity).alias("name"), F.col(key).alias("id"), F.struct(*parents.columns).alias("data"))
    rows = parents.select(
        F.col(key), row_id("relational", source, F.lit(entity), F.col(key)).alias("_id"), text.alias("_text"), (F.map_concat(base, *more) if more else base).alias("_meta"), own.alias("entity"),
        (files if files is not None else F.array().cast("array<string>")).alias("_assets"), *[F.col(r.parent_key).alias(f"_{name}") for name, (_, r, _) in children.items()],
    )
    for name, (df, r, pk) in children.items():
        owned = df.where(F.col(r.child_key).isNotNull()).groupBy(pk).agg(F.min(F.struct(F.col(r.child_key).alias("_up"), *[c for c in df.columns if c != r.child_key])).alias("_x"))
        data = F.struct(*[(F.col("_x._up") if c == r.child_key else F.col(pk) if c == pk else F.col("_x")[c]).alias(c) for c in df.columns])
        items = owned.groupBy(F.col("_x._up").alias("_k")).agg(F.sort_array(F.collect_list(F.struct(F.col(pk).alias("id"), data.alias("data")))).alias("_items"))
        met = rows.join(items, F.col(f"_{name}") == F.col("_k"), "left")
        none = F.array().cast(items.schema["_items"].dataType)
        rows = met.withColumn(f"_{name}", F.when(F.col(f"_{name}").isNotNull(), F.struct(F.lit(r.kind).alias("type"), F.coalesce("_items", none).alias("data")))).drop("_k", "_items")
    related_to = F.struct(*[F.col(f"_{name}").alias(name) for name in children]) if children else F.lit(None).cast("string")
    structured = F.to_json(F.struct(F.col("entity"), related_to.alias("relationships")))
    return rows.select(F.col("_id").alias("id"), F.col("_text").alias("text"), F.col("_meta").alias("metadata"), structured.alias("structured"), F.col("_assets").alias("assets"))
