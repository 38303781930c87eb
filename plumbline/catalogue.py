"""All registered queries of the drawing engine, with their SQL."""

from __future__ import annotations

from importlib import import_module

from .session import ship_package

_MODULES = ("quantities", "shaping", "matching", "spatial", "cleanup", "lookups", "drawings", "previews")


def _modules():
    return [import_module(f"{__package__}.plans.{name}") for name in _MODULES]


def _shipped(query):
    def run(spark, sf_dir):
        ship_package(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict:
    return {q.__name__: _shipped(q) for m in _modules() for q in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
