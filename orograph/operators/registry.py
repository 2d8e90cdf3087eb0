"""A small registry that pairs each query with its oracle SQL."""

from __future__ import annotations


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Register the function below under its name, with the same query in SQL."""

        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return add
