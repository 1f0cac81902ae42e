"""The registered queries: each runs operators over the given tables."""

from __future__ import annotations

from importlib import import_module

MODULES = ("sources", "objects", "plans", "issues", "texts", "sequences", "replies", "repairs", "reports", "flows")


def _load():
    from rubrica.catalog import registry

    for name in MODULES:
        import_module(f"rubrica.catalog.{name}")
    return registry


def queries():
    return dict(_load().QUERIES)


def oracle_sql():
    return dict(_load().ORACLE)
