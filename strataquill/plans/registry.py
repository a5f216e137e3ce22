"""Where query modules put their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name; SQL by name where an equivalent exists."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None, **types: str) -> Callable[[Query], Query]:
        """Register a query; ``types`` casts columns of the SQL to the types that Spark gives them."""

        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"two queries are named {name}")
            self.queries[name] = f
            if sql is not None:
                casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in types.items())
                self.sql[name] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql
            return f

        return add
