"""Collects the registered queries and their SQL twins."""

from __future__ import annotations

from surveyspark.queries import catalog, cleaning, modelling, reporting, requesting, structure

MODULES = (catalog, cleaning, requesting, modelling, reporting, structure)


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
