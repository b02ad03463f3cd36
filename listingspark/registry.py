"""Named queries over the test tables, one for each operator, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from listingspark.plans.fixtures import ctes, view


class Views:
    """The fixture views and test tables of one folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, views: list[str] | None = None, sql: str | None = None):
    """Registers a function of Views; ``sql`` may use the views by name."""

    def add(f: Callable[[Views], DataFrame]):
        _queries[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            _sql[name] = (ctes(views) + "\n" + sql) if views else sql
        return f

    return add


def _load() -> None:
    from listingspark.plans import queries_alerts, queries_enrich, queries_extract, queries_features, queries_io, queries_report, queries_resolve, queries_score  # noqa: F401


def queries() -> dict:
    _load()
    return _queries


def oracle_sql() -> dict[str, str]:
    _load()
    return _sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live listings that pass the hard gates, one of each address, with their nearest station."""
    return queries()["flagship"](spark, sf_dir)
