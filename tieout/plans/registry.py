"""Collects the registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tieout.sources.sinks import landed
from tieout.sources.views import ledger_buckets, table, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Attribute access to canonical tables: ``t.schedule_line``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._memo = spark, sf_dir, {}

    def shared(self, name: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        """A step that several queries use: landed once (``by`` a key: in as many buckets as the ledger's), then read from there."""
        return landed(self.spark, self.sf_dir, name, build) if by is None else landed(self.spark, self.sf_dir, name, build, by, self.buckets())

    def buckets(self) -> int:
        return ledger_buckets(self.spark, self.sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name, self._memo)


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``oracle`` may use canonical table names."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return wrap
