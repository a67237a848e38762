"""The registered queries of the engine's own operators, and their oracles."""

from __future__ import annotations

from vesperine.plans import evaluation, roundtrips, texts, vectors

_MODULES = (vectors, texts, evaluation, roundtrips)


def queries() -> dict:
    return {query.__name__: query for module in _MODULES for query in module.QUERIES}


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _MODULES:
        found |= module.oracles()
    return found
