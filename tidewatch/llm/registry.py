"""The queries of this package and the SQL that must give the same rows, where SQL can say it."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def load_all() -> None:
    from tidewatch.llm import queries  # noqa: F401
