"""How queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
        """Decorator: the function gets a table loader and returns the result."""

        def put(function: Callable) -> Callable:
            if name in self.queries:
                raise ValueError(f"query {name} is there already")
            self.queries[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
            if sql:
                self.sql[name] = sql.strip()
            return function

        return put


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
