"""Registry of the queries and of their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hustings.plans.fixtures import Views, with_views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query; `sql` may use the named views."""

    def register(build: Callable[[Views], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = with_views(sql, *views.split())
        return build

    return register


def runner(build: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Views(spark, sf_dir))

    return run
