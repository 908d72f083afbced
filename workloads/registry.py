"""Queries by name, each with the SQL that must give the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workloads.fixtures import DOC_LABELS_SQL, EVENTS_NUM_SQL, ORDERS_WIDE_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_VIEWS = {"orders_wide": ORDERS_WIDE_SQL, "doc_labels": DOC_LABELS_SQL, "events_num": EVENTS_NUM_SQL}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name; ``sql`` may use the fixture views."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key!r} is registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return fn

    return register


def with_views(sql: str) -> str:
    """Put the fixture views a statement mentions in front of it."""
    used = [text for view, text in _VIEWS.items() if view in sql]
    body = sql.strip()
    if not used:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",".join(used).strip() + ", " + body[5:]
    return "WITH " + ",".join(used).strip() + "\n" + body
