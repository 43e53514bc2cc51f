"""All queries of the core, by name."""

from __future__ import annotations

from quarrylight.plans import entities, pipeline, relations, retrieval, texts

_MODULES = (relations, texts, retrieval, entities, pipeline)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
