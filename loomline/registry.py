"""Queries and their SQL equivalents, collected by decorator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Named queries; each may carry the SQL that must return the same rows."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return add


def tree_sql(hashes: str) -> str:
    """SQL of the root of the hash tree over the rows of a query with a column `hash`."""
    return f"""(with l1 as (select left(hash, 6) as node, sha256(string_agg(hash, '' order by hash)) as h from ({hashes}) x group by 1),
      l2 as (select left(node, 3) as node, sha256(string_agg(h, '' order by node)) as h from l1 group by 1) select sha256(string_agg(h, '' order by node)) as root from l2)"""


CORE = Registry()
