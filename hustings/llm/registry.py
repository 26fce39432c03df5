"""Registry of the corpus queries and of their SQL."""

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def load() -> None:
    """Import the modules that register queries."""
    for name in MODULES:
        import_module(f"hustings.llm.{name}")


MODULES = (
    "passages", "token_files", "decontaminate", "simhash", "quantise", "language_model", "archives", "toxicity", "mixing", "secrets",
    "pieces", "aligned_tokens", "bounded_clusters",
)
