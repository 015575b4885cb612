"""A query is a DataFrame function with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    runs: dict[str, Run] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None) -> Callable[[Run], Run]:
        def add(run: Run) -> Run:
            if name in self.runs:
                raise ValueError(f"two queries are named {name}")
            self.runs[name] = run
            if sql:
                self.sql[name] = sql
            return run

        return add


registry = Registry()
query = registry.query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
