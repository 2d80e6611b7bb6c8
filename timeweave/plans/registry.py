"""One register of queries and their SQL for a module."""

from __future__ import annotations

from ..sources.derived import with_tables


class Register:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None, *tables: str):
        def register(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = with_tables(*tables, body=sql) if tables else sql
            return f

        return register
