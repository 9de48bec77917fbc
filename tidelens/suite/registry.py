"""Registry of the checked queries: a Spark job and, where SQL can say it, the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidelens.session import configure
from tidelens.suite.views import Views, with_views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Views], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Views(configure(spark), sf_dir))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query. ``views`` names the derived tables the SQL reads."""

    def wrap(build):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, build, with_views(views.split(), sql) if sql else None)
        return build

    return wrap
