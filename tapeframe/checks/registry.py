"""Named queries over the benchmark tables and, where plain SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapters import Episodes, episodes
from .sql import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PLANS: dict[str, Callable[[Episodes], DataFrame]] = {}


def check(name: str, *, views: str = "", ctes: str = "", select: str | None = None):
    """Registers fn(episodes) under `name`; `select` is the SQL counterpart over `views` and `ctes`."""

    def register(fn: Callable[[Episodes], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = fn
        QUERIES[name] = lambda spark, folder: fn(episodes(spark, folder))
        if select is not None:
            SQL[name] = with_views(views, ctes, select)
        return fn

    return register
