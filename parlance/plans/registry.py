"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from parlance.functions.text import WS

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            # White space in the SQL twins is that of Unicode, as it is in the functions.
            ORACLES[name] = sql.replace("\\s", WS)
        return fn

    return keep
