"""Named queries over the catalog, each with its check SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from lumenary.plans.catalog import Catalog
from lumenary.plans.check_sql import with_views
from lumenary.session import shipped

Query = Callable[[Catalog], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None, extra: dict | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = with_views(views, sql, extra)
        return fn

    return register


def runner(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
    return shipped(lambda spark, sf_dir: fn(Catalog(spark, sf_dir)))


TOPICS = ("text", "vector", "listing", "search", "identity", "tuning", "hygiene", "timeline", "ingest", "stream")


def load_all() -> None:
    for topic in TOPICS:
        import_module(f"lumenary.plans.{topic}_queries")
