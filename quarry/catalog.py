"""The registered queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from .plans import code, evaluation, graph, lifecycle, retrieval, stream, temporal, tools

MODULES = (temporal, retrieval, graph, lifecycle, code, evaluation, stream, tools)


def queries() -> dict:
    return {k: q for m in MODULES for k, (q, _) in m.CATALOG.items()}


def oracles() -> dict[str, str]:
    return {k: sql for m in MODULES for k, (_, sql) in m.CATALOG.items() if sql}
