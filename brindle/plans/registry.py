"""Named queries: each takes (spark, sf_dir) and returns a lazy DataFrame, some with an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Decorator that files a query, and the SQL that gives the same rows where SQL can say it."""

        def keep(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is filed twice")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql.strip()
            return fn

        return keep

    def sql_query(self, name: str, spark_sql: str, tables: tuple[str, ...], sql: str | None = None) -> None:
        """A query written in SQL over views of the named tables; ``sql`` when the oracle's dialect differs."""
        from brindle.session import table

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.sql(spark_sql, **{t: table(spark, sf_dir, t) for t in tables})

        text = spark_sql
        for t in tables:
            text = text.replace("{" + t + "}", t)
        self.add(name, text if sql is None else sql)(run)
