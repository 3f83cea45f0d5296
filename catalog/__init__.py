"""Queries over the driver tables, each next to the SQL that must give the same rows."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query; without `sql` only its rows are checked."""

    def add(build):
        if name in QUERIES:
            raise ValueError(f"Query {name} is registered twice.")
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add


def load_all() -> None:
    from catalog import cleaning, decisions, ingest, modelling, runs, texts  # noqa: F401
