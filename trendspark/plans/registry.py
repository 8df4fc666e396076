"""Query registry: every operator query is a function (spark, sf_dir) -> DataFrame,
optionally paired with an equivalent DuckDB SQL string used as oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that its queries register themselves."""
    import importlib
    for mod in MODULES:
        name = f"trendspark.plans.{mod}"
        try:
            importlib.import_module(name)
        except ModuleNotFoundError as e:  # module not written yet
            if e.name != name:
                raise


MODULES = ("q_trend", "q_text", "q_profile", "q_sampling", "q_bow", "q_topics", "q_vectors",
           "q_events", "q_quality", "q_predict", "q_ml", "q_stream")
