"""Named queries over the benchmark tables, with SQL that repeats them.

Each query is a function of ``(spark, sf_dir)``; ``@query(sql)`` registers it.
Without SQL the tests hold it against a plain version on a small fixture.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


from spindrift.plans import algorithms, elements, functions, inspect, patterns, routes, search, temporal  # noqa: E402, F401
