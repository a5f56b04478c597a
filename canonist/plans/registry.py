"""The table of registered queries and of the SQL that states the same."""

from __future__ import annotations

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL for its rows where there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register
