"""All queries of the core and the SQL they are compared with.

A query takes (spark, folder of the tables) and covers its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


from paperloom.plans import (  # noqa: E402, F401
    classify_queries,
    corpus_queries,
    evaluate_queries,
    extract_queries,
    join_queries,
    layout_queries,
    model_queries,
    text_queries,
    value_queries,
)
