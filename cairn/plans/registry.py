"""All queries of the core, by name."""

from __future__ import annotations

from cairn.plans import desk, entities, features, general, kernels, landed, merging

_MODULES = (general, features, entities, kernels, merging, landed, desk)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}
