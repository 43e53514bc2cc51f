"""Queries on the relational workbook: p2 (hierarchies) and p3 (orphan references)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import hierarchy as H
from quarrylight.operators import orphans as O
from quarrylight.operators.skew import valid_version
from quarrylight.scratch import write_out


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def workbook_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the workbook as the two configuration tables (a few fixed rows, read on the driver) relate them.

    A self reference outranks a reference to another table.
    """
    tables = {r["name"]: r for r in table(spark, sf, "table_config").collect()}
    rels = sorted((r for r in table(spark, sf, "relationship_config").collect()), key=lambda r: r["rel_type"] != "self_reference")
    nodes = None
    for name, conf in tables.items():
        if not conf["primary_key"]:
            continue
        pk = conf["primary_key"].lower()
        mine = [r for r in rels if r["target_table"] == name]
        rows = valid_version(table(spark, sf, conf["sheet_name"].lower()).select(pk, "loaded_at", *dict.fromkeys(r["target_key"] for r in mine if r["target_key"] != pk)), pk)
        parent = [F.concat(F.lit(f"{r['source_table']}:"), F.col(r["target_key"]).cast("string")) for r in mine]
        label = F.concat(F.lit(f"{name}:"), F.col(pk).cast("string"))
        part = rows.select(label.alias("node"), (F.coalesce(*parent) if parent else F.lit(None).cast("string")).alias("parent"), label.alias("label"), F.col(pk).cast("bigint").alias("rank"))
        nodes = part if nodes is None else nodes.unionByName(part)
    return nodes


def _id(col: str):
    return F.element_at(F.split(col, ":"), 2).cast("bigint")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    tree = H.hierarchy(workbook_nodes(spark, sf))
    path = F.when(F.col("kind") == H.TREE, F.array_join("path", "/")).when(F.col("kind") == H.LOOP, "cycle").otherwise("below cycle")
    return tree.select(
        F.element_at(F.split("node", ":"), 1).alias("node_table"), _id("node").alias("node_id"),
        F.element_at(F.split("root", ":"), 1).alias("root_table"), _id("root").alias("root_id"), "depth", path.alias("path"),
    )


def p2_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return H.descendants(H.hierarchy(workbook_nodes(spark, sf)))


def workbook_references(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """References of steps, sections, section images and documents, and the status of what they may name, with a target prefix in ``key``."""
    step, section = (valid_version(table(spark, sf, t), "id").where(F.col("deleted_at").isNull()) for t in ("guidestep", "guidestepsection"))
    doc = valid_version(table(spark, sf, "guidedoc"), "row_no")
    image = F.expr("try_variant_get(try_parse_json(content), '$.image.name', 'string')")

    def to(target: str, key):
        return F.concat(F.lit(f"{target}:"), key.cast("string"))

    refs = [
        O.references(step, "guidestep", "id", "guideid", to("guide", F.col("guideid"))),
        O.references(section, "guidestepsection", "id", "stepid", to("step", F.col("stepid"))),
        O.references(section, "guidestepsection", "id", "parentsectionid", to("section", F.col("parentsectionid"))),
        O.references(section.withColumn("image", image), "guidestepsection", "id", "content", to("asset", O.file_key(F.col("image")))),
        O.references(doc, "guidedoc", "row_no", "sectionid", to("section", O.whole_number(F.col("sectionid")))),
        O.references(doc, "guidedoc", "row_no", "docname", to("asset", O.file_key(F.col("docname")))),
    ]
    targets = [
        O.target_status(table(spark, sf, "guide"), to("guide", F.col("id"))),
        O.target_status(table(spark, sf, "guidestep"), to("step", F.col("id"))),
        O.target_status(table(spark, sf, "guidestepsection"), to("section", F.col("id"))),
        O.target_status(table(spark, sf, "asset_file"), to("asset", O.file_key(F.col("asset_name")))),
    ]
    both = []
    for frames in (refs, targets):
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        both.append(out)
    return write_out(both[0]), write_out(both[1])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return O.orphan_rows(*workbook_references(spark, sf))


def p3_orphan_counts(spark: SparkSession, sf: str) -> DataFrame:
    return O.orphan_counts(*workbook_references(spark, sf))


QUERIES = {"p2_found": p2_found, "p2_descendants": p2_descendants, "p3_found": p3_found, "p3_orphan_counts": p3_orphan_counts}

_NODES = """
v_guide AS (SELECT id FROM guide WHERE id IS NOT NULL GROUP BY id),
v_step AS (SELECT id, arg_max(coalesce(guideid, -9223372036854775807), loaded_at) AS p FROM guidestep WHERE id IS NOT NULL GROUP BY id),
v_section AS (SELECT id, arg_max(coalesce(parentsectionid, -9223372036854775807), loaded_at) AS ps, arg_max(coalesce(stepid, -9223372036854775807), loaded_at) AS st FROM guidestepsection WHERE id IS NOT NULL GROUP BY id),
raw AS (
  SELECT 'guide' AS t, id, NULL AS pt, NULL::BIGINT AS pid FROM v_guide
  UNION ALL SELECT 'step', id, 'guide', nullif(p, -9223372036854775807) FROM v_step
  UNION ALL SELECT 'section', id, CASE WHEN ps <> -9223372036854775807 THEN 'section' ELSE 'step' END,
    CASE WHEN ps <> -9223372036854775807 THEN ps ELSE nullif(st, -9223372036854775807) END FROM v_section),
n AS (SELECT a.t, a.id, CASE WHEN b.id IS NOT NULL THEN a.pt END AS pt, b.id AS pid FROM raw a LEFT JOIN raw b ON a.pt = b.t AND a.pid = b.id),
tree AS (
  SELECT t, id, t AS rt, id AS rid, 0::BIGINT AS depth, t || ':' || id AS path FROM n WHERE pid IS NULL
  UNION ALL SELECT n.t, n.id, tree.rt, tree.rid, tree.depth + 1, tree.path || '/' || n.t || ':' || n.id FROM n JOIN tree ON n.pt = tree.t AND n.pid = tree.id)"""

_LOOPS = """
loose AS (SELECT n.* FROM n ANTI JOIN tree ON n.t = tree.t AND n.id = tree.id),
walk AS (
  SELECT id AS start, id, pid, 0 AS k FROM loose WHERE t = 'section' AND pt = 'section'
  UNION SELECT w.start, l.id, l.pid, 0 FROM walk w JOIN loose l ON l.t = 'section' AND l.id = w.pid),
on_loop AS (SELECT DISTINCT w.start AS id FROM walk w WHERE w.pid = w.start)"""

_P2 = f"""WITH RECURSIVE {_NODES},{_LOOPS},
root_of AS (SELECT w.start AS id, min(w.id) AS rid FROM walk w JOIN on_loop o ON w.id = o.id GROUP BY w.start)
SELECT t AS node_table, id AS node_id, rt AS root_table, rid AS root_id, depth, path FROM tree
UNION ALL SELECT l.t, l.id, 'section', r.rid, -1, CASE WHEN l.id IN (SELECT id FROM on_loop) THEN 'cycle' ELSE 'below cycle' END
FROM loose l JOIN root_of r ON l.id = r.id"""

_P2_DESC = f"""WITH RECURSIVE {_NODES},{_LOOPS},
under AS (
  SELECT 'section' AS t, id, ['section:' || id] AS p FROM on_loop
  UNION ALL SELECT n.t, n.id, list_append(under.p, n.t || ':' || n.id) FROM n JOIN under ON n.pt = under.t AND n.pid = under.id
  WHERE NOT (n.t = 'section' AND n.id IN (SELECT id FROM on_loop))),
parts AS (SELECT string_split(path, '/') AS p FROM tree UNION ALL SELECT p FROM under)
SELECT p[i] AS ancestor, p[len(p)] AS descendant, len(p) - i AS distance FROM parts, unnest(range(1, len(p))) AS u(i)"""

_REFS = r"""
last AS (SELECT * FROM guidestep WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1),
lasts AS (SELECT * FROM guidestepsection WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1),
lastd AS (SELECT * FROM guidedoc WHERE row_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY loaded_at DESC) = 1),
raw AS (
  SELECT 'guidestep' AS child_table, id AS child_key, 'guideid' AS ref_column, 'guide:' || guideid AS key, loaded_at AS seen_at FROM last WHERE deleted_at IS NULL
  UNION ALL SELECT 'guidestepsection', id, 'stepid', 'step:' || stepid, loaded_at FROM lasts WHERE deleted_at IS NULL
  UNION ALL SELECT 'guidestepsection', id, 'parentsectionid', 'section:' || parentsectionid, loaded_at FROM lasts WHERE deleted_at IS NULL
  UNION ALL SELECT 'guidestepsection', id, 'content', 'asset:' || nullif(lower(trim(replace(regexp_replace(CASE WHEN json_valid(content) THEN json_extract_string(content, '$.image.name') END, '^.*[/\\]', '', 's'), '%20', ' '), E' \t\r\n')), ''), loaded_at FROM lasts WHERE deleted_at IS NULL
  UNION ALL SELECT 'guidedoc', row_no, 'sectionid', 'section:' || try_cast(nullif(regexp_extract(sectionid, '^\s*(\d+)(\.0)?\s*$', 1), '') AS BIGINT), loaded_at FROM lastd
  UNION ALL SELECT 'guidedoc', row_no, 'docname', 'asset:' || nullif(lower(trim(replace(regexp_replace(docname, '^.*[/\\]', '', 's'), '%20', ' '), E' \t\r\n')), ''), loaded_at FROM lastd),
refs AS (SELECT * FROM raw WHERE key IS NOT NULL),
tv AS (
  SELECT 'guide:' || id AS key, loaded_at, deleted_at FROM guide UNION ALL SELECT 'step:' || id, loaded_at, deleted_at FROM guidestep
  UNION ALL SELECT 'section:' || id, loaded_at, deleted_at FROM guidestepsection
  UNION ALL SELECT 'asset:' || lower(trim(replace(regexp_replace(asset_name, '^.*[/\\]', '', 's'), '%20', ' '), E' \t\r\n')), loaded_at, deleted_at FROM asset_file),
ts AS (SELECT key, arg_max(deleted_at IS NOT NULL, loaded_at) AS deleted, min(loaded_at) AS first_loaded FROM tv GROUP BY key),
bad AS (
  SELECT r.*, CASE WHEN t.key IS NULL THEN 'missing' WHEN t.deleted THEN 'deleted' WHEN t.first_loaded > r.seen_at THEN 'late' END AS reason
  FROM refs r LEFT JOIN ts t ON r.key = t.key)"""

SQL = {
    "p2_found": _P2,
    "p2_descendants": _P2_DESC,
    "p3_found": f"WITH {_REFS} SELECT child_table, child_key, ref_column, reason, strftime(seen_at, '%Y-%m') AS period FROM bad WHERE reason IS NOT NULL",
    "p3_orphan_counts": f"WITH {_REFS} SELECT child_table, ref_column, reason, strftime(seen_at, '%Y-%m') AS period, count(*) AS n_refs, count(DISTINCT key) AS n_keys FROM bad WHERE reason IS NOT NULL GROUP BY ALL",
}
