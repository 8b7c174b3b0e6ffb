"""Registration of queries."""

from __future__ import annotations


def registered(queries: dict, oracles: dict):
    """A decorator that files a query under its name, with its SQL if there is any."""

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return query
