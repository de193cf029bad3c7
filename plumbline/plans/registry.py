"""Queries by name: a function of (spark, directory of tables), and SQL where it can say the
same over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from plumbline.session import ship

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} exists")

            @wraps(query)
            def shipped(spark: SparkSession, root: str) -> DataFrame:
                ship(spark)
                return query(spark, root)

            self.queries[name] = shipped
            if sql:
                self.sql[name] = sql.strip()
            return shipped

        return put
