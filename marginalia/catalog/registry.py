"""Query registration shared by the catalog modules."""

from __future__ import annotations


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict = {}

    def __call__(self, name: str, sql: str | None = None):
        def wrap(fn):
            if name in self.queries:
                raise ValueError(f"query registered twice: {name}")
            self.queries[name] = fn
            if sql:
                self.oracles[name] = sql
            return fn

        return wrap
