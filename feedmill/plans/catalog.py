"""The registry of runnable queries: a Spark plan over the given tables and, where SQL can say the
same, the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from feedmill.plans import views

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


class Tables:
    """Feature tables by attribute, e.g. ``Tables(spark, sf_dir).articles``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in views.VIEWS:
            return views.view(self.spark, self.sf_dir, name)
        if name == "landed_feeds":
            return views.landed_feeds(self.spark, self.sf_dir)
        if name == "landed_pages":
            return views.landed_pages(self.spark, self.sf_dir)
        return views.given(self.spark, self.sf_dir, name)


def query(name: str, ids: str, sql: str | None = None, use: str = "") -> Callable:
    """Register a plan.  ``use`` names the views its SQL inlines."""

    def register(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        text = None if sql is None else views.check_sql(sql, *use.split())
        QUERIES[name] = Query(name, tuple(ids.split()), lambda spark, sf_dir: plan(Tables(spark, sf_dir)), text)
        return plan

    return register


def load() -> dict[str, Query]:
    """All queries, registered on first use."""
    for module in ("ingest", "text", "serve", "state", "vectors", "streams"):
        importlib.import_module(f"feedmill.plans.queries_{module}")
    return QUERIES
