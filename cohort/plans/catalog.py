"""Registry of queries on the test tables, each with its SQL counterpart where there is one."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources import scan

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


class Tables:
    """Lazy access to the tables of one folder: ``t.orders``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return scan(self.spark, self.root, name)

    @cached_property
    def labelled(self) -> DataFrame:
        """Documents with their labels, null where unlabelled."""
        return self.documents.join(self.labels, "doc_id", "left")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under a name."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, root: fn(Tables(spark, root))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def holed(c: str, key: str, every: int = 7) -> Column:
    """The test tables hold no nulls, so some are made: where ``key`` is a multiple of ``every``."""
    return F.when(F.col(key) % every != 0, F.col(c))
