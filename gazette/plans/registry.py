"""Registry of named queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from ..sources.model import Model
from .oracle import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(model) -> DataFrame`` as query ``name`` (with oracle SQL)."""

    def deco(fn: Callable[[Model], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(Model(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return deco


MODULES = ["serving", "ingest", "delivery", "extraction", "site_rules", "jobs", "enrichment", "scalars", "checks", "constraints", "sinks",
           "streams"]


def load_all() -> None:
    import importlib

    for mod in MODULES:
        importlib.import_module(f"{__package__}.{mod}")
