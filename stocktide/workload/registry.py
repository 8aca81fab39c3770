"""Query registry: key, Spark function, SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stocktide.workload.roles import frame, oracle, tasks

Query = Callable[[SparkSession, str], DataFrame]


class Inputs:
    """Roles by attribute: ``i.norm`` is the role's frame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def tasks(self) -> int | None:
        return tasks(self.spark, self.sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return frame(self.spark, self.sf_dir, name)


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, key: str, build: Callable[[Inputs], DataFrame], sql: str | None = None) -> None:
        if key in self.queries:
            raise KeyError(f"query {key} is registered twice")
        self.queries[key] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if sql:
            self.sql[key] = oracle(sql)
